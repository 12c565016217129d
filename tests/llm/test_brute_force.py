"""Operators beside plain versions on small fixtures."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import PATTERN, path

from shelfmark.llm import (
    bpe_codec, ctw, jaccard_join, license_scan, line_crf, packing, quality_rules, top_k, url_rules,
)

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(n=60):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    made = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        made[i] = " ".join(copy if i % 3 else copy[: rng.randint(90, 120)])
    for i in range(n, n + 20):
        made[i] = " ".join(base[:40] + [rng.choice(words) + str(i) for _ in range(60)])
    made |= {200: "a b c d e", 201: "A b c d e", 202: "a b", 203: "A  B", 204: "", 205: "a b c d f"}
    return made


def test_jaccard_join(spark, texts):
    for own in (texts, near_copies()):
        rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_sets(rows).collect()}
        assert found == plain_components(own)


def test_jaccard_with_few_frequent_shingles(spark):
    own = near_copies()
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_sets(rows, frequent_limit=10).collect()}
    assert found == plain_components(own)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    import zlib

    pieces = packing.pack_documents(docs, path("byte_bpe_50k.json")).collect()
    covered, rooms = {i: [] for i in ids}, {}
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        covered[p.doc_id] += range(p.start, p.start + p.length)
        rooms.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sorted(c) == list(range(len(ids[i]))) for i, c in covered.items())
    total = padded = 0
    for held in rooms.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else 1024)
    assert padded <= 1.01 * total


@pytest.mark.parametrize("text", ["", "a  b", "a \n b", "\n b\n\n c", " a", " ", "\xa0 b c", "a <|endoftext|> b", " x\ty 's 're don't", "a\x1cb \x1c c", "日本 語", "a\nb c\n", "\0 a"])
def test_cached_ids(text):
    own = packing.cached_tokenizer(path("byte_bpe_50k.json"))
    assert own.encode(text) == own.whole(text)


def test_best_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(500)]
    rooms = []
    for length in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= length), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((1024 if best is None else best) - length)
    found = packing.best_fit_decreasing(lengths)
    assert sorted(1024 - sum(lengths[i] for i in w) for w in found) == sorted(rooms)
    assert sorted(i for w in found for i in w) == list(range(500))


def test_codec(docs, texts):
    import hashlib

    coding = bpe_codec.encoding(path("byte_bpe_50k.tiktoken"), PATTERN)
    for r in bpe_codec.round_trip_digests(docs, path("byte_bpe_50k.tiktoken"), PATTERN).collect():
        ids = coding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_codec_cuts_safely():
    text = "ab cd  ef\n\n gh 's it's\t" * 9000 + " " * 700 + "x" * 70_000
    coding = bpe_codec.encoding(path("byte_bpe_50k.tiktoken"), PATTERN)
    assert bpe_codec.encode(text, path("byte_bpe_50k.tiktoken"), PATTERN) == coding.encode_ordinary(text)


def plain_ctw(train, held, depth=ctw.DEPTH):
    """Context-tree weighting over dictionaries of (place on the bits' path, context)."""
    nodes, children = {}, {}
    for text in train:
        data = ctw.START + text + ctw.END
        for i in range(depth, len(data)):
            for j in range(8):
                for d in range(depth + 1):
                    key = ((1 << j) | (data[i] >> (8 - j)), data[i - d : i])
                    nodes.setdefault(key, [0, 0])[data[i] >> (7 - j) & 1] += 1
    for place, context in nodes:
        if context:
            children.setdefault((place, context[1:]), []).append((place, context))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(key):
        if len(key[1]) == depth:
            return kt(nodes[key])
        return float(np.logaddexp(kt(nodes[key]), sum(map(weighted, children.get(key, []))))) - math.log(2)

    def one(place, context, d):
        key = (place, context[depth - d :])
        if key not in nodes:
            return 0.5
        own = (nodes[key][1] + 0.5) / (sum(nodes[key]) + 1)
        if d == depth:
            return own
        share = math.exp(kt(nodes[key]) - math.log(2) - weighted(key))
        return share * own + (1 - share) * one(place, context, d + 1)

    scores = []
    for text in held:
        data, score = ctw.START + text + ctw.END, 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                p = one((1 << j) | (data[i] >> (8 - j)), data[i - depth : i], 0)
                score += math.log10(p if data[i] >> (7 - j) & 1 else 1 - p)
        scores.append(score)
    return scores


def test_ctw(spark):
    import zlib

    rng = random.Random(3)
    own = {i: "".join(rng.choice("Abc d\n") for _ in range(rng.randint(0, 25))) for i in range(40)} | {40: None, 41: "é zz"}
    held = {i for i in own if zlib.crc32(str(i).encode()) % 7 == 2}
    lower = {i: (t or "").translate(LOWER).encode() for i, t in own.items()}
    scores = dict(zip(lower, plain_ctw([t for i, t in lower.items() if i not in held], lower.values())))
    count = Counter(w for i, t in lower.items() if i not in held for w in [*t.split(), b""])
    n, v = sum(count.values()), len(count)
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = ctw.score_documents(rows, batch_bytes=150).collect()
    assert len(found) == len(own)
    for r in found:
        tokens = [*lower[r.doc_id].split(), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score == pytest.approx(scores[r.doc_id])


def test_field_marginals():
    rng = np.random.default_rng(2)
    x, sizes = rng.normal(size=(3, 5, line_crf.N_FEATURES)), np.array([5, 1, 3])
    field = line_crf.Field(rng.normal(size=line_crf.N_FEATURES), np.array([0.7, 1.3]))
    p, _ = line_crf.marginals(field, x, sizes)
    for doc, size in enumerate(sizes):
        weight, good = 0.0, np.zeros(size)
        for y in itertools.product((0, 1), repeat=int(size)):
            w = sum(x[doc, t] @ field.weights for t in range(size) if y[t]) + sum(field.stay[1 - y[t]] for t in range(size - 1) if y[t] == y[t + 1])
            weight += math.exp(w)
            good += math.exp(w) * np.array(y)
        assert p[doc, :size] == pytest.approx(good / weight)


def test_url_joins_agree(spark):
    rng = random.Random(4)
    labels, paths = ["com", "net", "a", "b", "www"], ["", "/", "/en/", "/en/x", "/es/"]
    name = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({url_rules.Rule(rng.choice(["allow", "block"]), name(), rng.choice(paths)) for _ in range(30)})
    urls = [f"http://{name()}{rng.choice(paths)}" for _ in range(200)]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    swept, joined = (sorted(map(tuple, url_rules.judge_urls(pages, frame, max_shipped=n).collect())) for n in (1000, 1))
    assert swept == joined
    for (_, host, path_, rule, verdict), url in zip(swept, urls):
        assert url == f"http://{host}{path_}"
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path_.startswith(r.path)]
        best = max(fits, key=lambda r: r.rank, default=None)
        assert (rule, verdict) == ((best.host + best.path, best.verdict) if best else (None, "allow"))


def test_licenses(spark, docs, texts):
    own = texts | {10_001: "x\nReleased under THE mit-license, today\nBY cc by nc CC by\u00a0nc", 10_002: "under the mit license under the mit license", 10_003: None}
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    for r in license_scan.scan_licenses(rows).collect():
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        text = own[r.doc_id] or ""
        w, places, base = words(text), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        best, labels = 0.0, set(base)
        for line in text.split("\n"):
            block = set(words(line))
            for template, label in license_scan.TEMPLATES:
                t = set(words(template))
                c = len(block & t) / len(t)
                if c >= license_scan.THRESHOLD:
                    labels.add(label)
                    best = max(best, c)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert r.score == best or (best == 0 and r.score < license_scan.THRESHOLD)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = {i: rng.normal(size=16).tolist() for i in range(0, 600)}
    v[7] = v[100]
    rows = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.exact_top_k(rows, rows.where("vec_id % 100 = 0"), block=100, query_block=3).collect()}
    whole = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in v.items()}
    for q in range(0, 600, 100):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:10]
        assert [found[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]


def test_quality_measures(spark, docs, texts):
    own = texts | {10_001: "a b c d e a b c d e f\n\n \na b\na b\n", 10_002: "x " * 30, 10_003: None, 10_004: "q#$|\x0b\x0cé"}
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    for r in quality_rules.base_measures(rows).collect():
        text = own[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
