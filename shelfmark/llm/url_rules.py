"""URL filters as a sort-merge range join of canonical keys with nested rule intervals.

A host's canonical key is its labels from the last to the first, each followed by a dot: ``www.example.com`` becomes
``com.example.www.``. A rule for a host and all its subdomains is then the interval of keys that start with the rule's
key, and two intervals are nested or disjoint. URLs are range-partitioned and sorted by key; each task sweeps its
sorted keys and the sorted hosts of rules once, with a stack of the hosts whose interval holds the current key. Of
their rules, the longest one whose path starts the URL's path wins; a host's rules are looked up by path.

Rules travel with the tasks, about ``max_shipped`` of them at most. More are dealt into as many portions as needed, each
of which is swept over the URLs alike; of a URL's winners the longest wins. Keys are spread by URL as well, so one hot
host is no single partition.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits an empty host; an empty
path starts with no rule path but the empty one; a URL that no rule fits gets the default verdict and a null rule;
equally long rules: the longer host wins, then block; repeated rows are all judged and kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import small_batches
from shelfmark.llm.shared import stored

#: Rules that are shipped to every task at a time, at most.
MAX_SHIPPED = 100_000


class Rule(NamedTuple):
    """``verdict`` (allow or block) of a host with its subdomains and a path that URLs must start with."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return reversed_host(self.host)

    @property
    def rank(self) -> tuple:
        return len(self.host) + len(self.path), len(self.host), self.verdict


def reversed_host(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule from text like ``example.com/en/``."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case ASCII letters and path of a URL column; empty where the URL has no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Host:
    """The rules of one host, by path."""

    def __init__(self, key: str):
        self.key, self.by_path, self.lengths = key, {}, []

    def add(self, rule: Rule) -> None:
        held = self.by_path.get(rule.path)
        if held is None or rule.rank > held.rank:
            self.by_path[rule.path] = rule
        if len(rule.path) not in self.lengths:
            self.lengths.append(len(rule.path))
            self.lengths.sort(reverse=True)

    def best(self, path: str) -> Rule | None:
        """The rule with the longest path that starts ``path``."""
        for length in self.lengths:
            if length <= len(path) and (rule := self.by_path.get(path[:length])):
                return rule
        return None


class Sweep:
    """The hosts of rules whose intervals hold the current key, for keys that only grow; innermost last."""

    def __init__(self, rules: Iterable[Rule]):
        hosts: dict[str, Host] = {}
        for rule in rules:
            key = rule.key
            hosts.setdefault(key, Host(key)).add(rule)
        self.hosts = [hosts[key] for key in sorted(hosts)]
        self.keys = [host.key for host in self.hosts]
        self.next, self.stack = 0, []

    def seek(self, key: str) -> None:
        """Begins at ``key``: active are the hosts whose key starts it."""
        self.next, self.stack = bisect_right(self.keys, key), []
        at = -1
        while (at := key.find(".", at + 1)) >= 0:
            first = bisect_right(self.keys, key[: at + 1])
            if first and self.keys[first - 1] == key[: at + 1]:
                self.stack.append(self.hosts[first - 1])

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        while self.next < len(self.hosts) and self.keys[self.next] <= key:
            host = self.hosts[self.next]
            while self.stack and not host.key.startswith(self.stack[-1].key):
                self.stack.pop()
            if key.startswith(host.key):
                self.stack.append(host)
            self.next += 1

    def best(self, path: str) -> Rule | None:
        return max(filter(None, (host.best(path) for host in self.stack)), key=lambda rule: rule.rank, default=None)


SWEPT_SCHEMA = "id long, page_id long, host string, path string, rule_host string, rule_path string, rule_verdict string"


def _swept(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (id, page_id, host, path) with the rule that wins among ``rules``, null without one."""
    labels = F.reverse(F.split("host", r"\."))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))
    keyed = urls.withColumn("key", key)
    dealt = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = Sweep(rules), None
        for batch in batches:
            found = []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist()):
                if last is None:
                    sweep.seek(key)
                elif key != last:
                    sweep.move(key)
                last = key
                found.append((sweep.best(path) if key else None) or (None, None, None))
            names = [field.split()[0] for field in SWEPT_SCHEMA.split(", ")]
            verdicts, hosts, paths = (pa.array([rule[i] for rule in found], pa.string()) for i in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), hosts, paths, verdicts], names=names)

    return dealt.mapInArrow(run, SWEPT_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """One row per page: page_id, host, path, the winning rule's text or null, the verdict.

    ``rules`` has the columns verdict (allow or block), host and path; rules with a null are none.
    """
    small_batches(pages.sparkSession, 10_000)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.lit(None).cast("long").alias("id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = rules.select("verdict", "host", "path").dropna().distinct()
    shipped = known.limit(max_shipped + 1).collect()
    if len(shipped) <= max_shipped:
        best = _swept(urls, [Rule(*row) for row in shipped])
    else:
        known, urls = stored(known, "rules"), stored(urls.withColumn("id", F.monotonically_increasing_id()), "urls")
        n_portions = -(-known.count() // max_shipped)
        portion = F.pmod(F.xxhash64("host", "path"), F.lit(n_portions))
        swept = None
        for n in range(n_portions):
            own = _swept(urls, [Rule(*row) for row in known.where(portion == n).collect()])
            swept = own if swept is None else swept.unionByName(own)
        rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("host"), F.col("rule_verdict").alias("verdict"))
        winner = F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), rank)
        best = swept.groupBy("id", "page_id", "host", "path").agg(winner.alias("w")).select("page_id", "host", "path", "w.*")
    return best.select(
        "page_id", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )
