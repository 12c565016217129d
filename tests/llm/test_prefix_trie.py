"""The prefix trie beside a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import prefix_trie
from shelfmark.llm.prefix_trie import Sequence, ZFastTrie


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    rebuilt, members, children, out = {}, {}, {}, []
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children.get(p, [])]
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + saved)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(below), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, families=14, copies=30):
    rng, rows = random.Random(seed), []
    for c in [*range(-10, families * 5), 2**62]:
        if rng.random() < 0.2:
            continue
        for t in rng.sample(range(20), rng.randrange(14)):
            rows.append((c, None if t == 7 else t, rng.choice(["u", "a", None]), rng.choice(["x", "é", None, "zz"]) if rng.random() < 0.25 else "q"))
    for c in range(1000, 1000 + 5 * copies, 5):  # one conversation many times, and a common first turn
        rows += [(c, t, "u", f"copy {t}") for t in range(12)]
        rows += [(c + 1, 0, "u", "copy 0"), (c + 1, 1, "a", f"own {c}")]
    return [*rows, (None, 0, "u", "no one")]


@pytest.mark.parametrize("group", [1, 4, None])
def test_beside_a_plain_version(spark, group):
    rows = talks(group or 9)
    talk = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    found = prefix_trie.prefix_trie(talk, group=group).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    # Without its family's first conversation, one that is shorter than what it borrows has no turns.
    conv = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(conv, 0, "u", "x"), (conv, 1, "u", "y")]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in found] == plain(rows) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_a_long_conversation(spark):
    rows = [(5, t, "u", f"t{t % 50}") for t in range(3000)] + [(6, t, "u", f"t{t % 50}") for t in range(2000)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefix_trie(talk).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def sequence(turns):
    key, keys = prefix_trie.ROOT, []
    for t in turns:
        key = hashlib.blake2b(key + bytes([t]), digest_size=16).digest()
        keys.append(key)
    return Sequence(b"".join(keys), np.ones(len(turns), np.int64).tobytes(), 1, 0, "")


def test_exits_are_found_by_fat_binary_search():
    rng = random.Random(2)
    for _ in range(200):
        trie, held = ZFastTrie(), set()
        made = {tuple(rng.randrange(2) for _ in range(rng.randrange(25))) for _ in range(40)}
        for batch in (list(made)[:15], list(made)[15:]):
            trie.insert_batch([sequence(t) for t in batch])
            held.update(batch)
        extents = {node.of.key(node.depth) if node.of else prefix_trie.ROOT: node for node in trie.nodes()}
        assert sum(node.end is not None for node in trie.nodes()) == len(held)
        assert len(trie.handles) == len(extents) - 1 and all(trie.handles[n.handle()] is n for n in extents.values() if n.of)
        for turns in [*made, *[tuple(rng.randrange(2) for _ in range(rng.randrange(30))) for _ in range(50)]]:
            seq = sequence(turns)
            deepest = max((d for d in range(seq.size + 1) if seq.key(d) in extents), default=0)
            assert trie.exit(seq).depth == deepest


def test_two_fattest():
    for low in range(-1, 40):
        for high in range(max(low + 1, 1), 60):
            f = prefix_trie.two_fattest(low, high) if low >= 0 else None
            if f:
                assert low < f <= high and all((x & -x) <= (f & -f) for x in range(low + 1, high + 1))
