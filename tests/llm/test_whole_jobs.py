"""Operators do the whole job: cases that a cut, cap or early end would lose."""

import itertools
import random

import numpy as np
import pytest
from test_brute_force import near_copies, shingles

from shelfmark.llm import jaccard_join, license_scan, line_crf, packing, top_k, url_rules


def plain_links(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = {i: set() for i in texts}
    for i, j in itertools.combinations(texts, 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[i] != sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            linked[i].add(sets[j])
            linked[j].add(sets[i])
    return {i: len(s) for i, s in linked.items()}


def drifting(n=60):
    """Texts that each differ a little from the one before, so that those far apart no longer link."""
    words = [f"v{i}" for i in range(160)]
    return {1000 + i: " ".join(words[i : i + 100]) for i in range(n)}


@pytest.mark.parametrize("blocks", [(1000, 200_000), (7, 600)])
def test_jaccard_counts_every_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks[0])
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", blocks[1])
    monkeypatch.setattr(jaccard_join, "BLOCK_COLUMNS", 4096 if blocks[0] == 1000 else 10)
    own = near_copies() | drifting()
    own |= {3000: own[5], 3001: own[1030], 3002: random.Random(1).choice(list(own.values()))}
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = {r.doc_id: r.n_links for r in jaccard_join.similar_sets(rows).collect()}
    assert found == plain_links(own)
    assert max(found.values()) > 16


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("x y z\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided", "bsd"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", "mpl-2"),
        ("one\nword\nReleased\nunder\nthe\nMIT\nLicense", "mit"),
        ("This work is licensed under the GNU General\nPublic License, version 3.", "gpl-3"),
    ],
)
def test_wrapped_license_notices(spark, text, labels):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.scan_licenses(rows).first().labels == labels


def test_field_is_fitted_on_late_lines(spark):
    clean = ["The river ran past the old mill.", "A letter came on Monday morning.", "They walked home together again."]
    rows, labels = [], []
    for i in range(40):
        lines = [clean[(i + j) % 3] + f" {j}." for j in range(70)]
        bad = i % 2
        rows.append((i, "\n".join(lines + ["$$$ ### buy buy buy buy ###"] * 30 * bad)))
        labels.append((i, 1 - bad))
    field = line_crf.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"))
    junk = line_crf.document_score(field, "$$$ ### buy buy buy buy ###\n" * 5)
    assert junk < 0.3
    assert line_crf.document_score(field, "\n".join(clean)) > junk + 0.2


def top(vectors, k=10):
    whole = {i: [int(np.floor(1024 * c)) for c in v] for i, v in vectors.items()}
    found = {}
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        found |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored[:k])}
    return found


@pytest.mark.parametrize("size", [0.1, 2000.0, 1e6, 1e8])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=8) * size).tolist() for i in range(300)} | {300: [0.0] * 8}
    if size == 1e8:  # products of 2**73, of which the best stay within 64 bits
        vectors = {i: [v[0], -v[0], *v[2:4], 0.0] for i, v in vectors.items()} | {i: [1.0, 0.5, 0.25, 3.0, v[4] / 1e8] for i, v in list(vectors.items())[::2]}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k.exact_top_k(rows, rows.where("vec_id % 100 = 0"), block=64).collect()}
    most = (1 << 63) - 1
    expected = {key: (i, max(-most, min(most, s))) for key, (i, s) in top(vectors).items()}
    if size < 1e8:
        assert found == expected
    else:
        assert {key: s for key, (_, s) in found.items()} == {key: s for key, (_, s) in expected.items()}


def test_top_k_counts_repeated_rows(spark):
    rows = spark.createDataFrame([(1, [1.0])] * 7 + [(2, [0.5])] * 9 + [(100, [1.0])] * 3, "vec_id long, embedding array<double>")
    found = top_k.exact_top_k(rows, rows.where("vec_id % 100 = 0"), block=2).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(n + 1, 1 if n < 7 else 2) for n in range(10)]


@pytest.mark.parametrize("bits", [4, 64])
def test_jaccard_tells_sets_with_equal_hashes_apart(spark, bits):
    own = {i: t for i, t in (near_copies() | drifting(20)).items() if i % 2 == 0}
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = {r.doc_id: r.n_links for r in jaccard_join.similar_sets(rows, id_bits=bits).collect()}
    assert found == plain_links(own)


def test_jaccard_lists_of_any_number_of_sets():
    rng = np.random.default_rng(3)
    h, a = rng.integers(0, 6, 300), rng.integers(0, 60, 300)
    n = 10 + a % 5
    i = (h + a) % 4
    x, y, long = jaccard_join.list_pairs(h, a, n, i, 80, 30)
    size = {v: len(set(a[h == v])) for v in set(h)}
    expected = set()
    for v in size:
        rows = {(a[r], n[r], i[r]) for r in range(300) if h[r] == v and size[v] <= 30}
        for (a1, n1, i1), (a2, n2, i2) in itertools.combinations(sorted(rows), 2):
            if 180 * min(n1 - i1, n2 - i2) >= 80 * (n1 + n2):
                expected.add((a1, a2))
    assert set(zip(x.tolist(), y.tolist())) == expected
    assert sorted(set(zip(h[long].tolist(), a[long].tolist()))) == sorted({(int(v), int(w)) for v, w in zip(h, a) if size[v] > 30})


def test_jaccard_packs_numbers():
    rng = np.random.default_rng(4)
    groups, numbers = rng.integers(0, 9, 500), rng.integers(0, 1 << jaccard_join.COUNTED_BITS, 500)
    found, packed = jaccard_join.steps(groups, numbers)
    for g, p in zip(found, packed):
        assert jaccard_join.numbers_of(p).tolist() == sorted(numbers[groups == g].tolist())


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc"),  # only the base phrase
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", ""),
        ("licensed under the license in version 2 0", ""),
        ("Licensed under the Apache License,\n  Version 2.0.", "apache-2"),
        ("a b c This work is licensed under a\n# Creative Commons Attribution 4.0 International\n# License. d e f", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and more", "mit"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "isc"),
        ("no license at all in this software", ""),
    ],
)
def test_near_equal_licenses_are_told_apart(spark, text, labels):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.scan_licenses(rows, telling=True).first().labels == labels


def test_every_template_gives_its_own_label(spark):
    rows = spark.createDataFrame([(i, t.replace(" ", "\n", 5)) for i, (t, _) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license_scan.scan_licenses(rows, telling=True).collect()}
    assert found == {i: label for i, (_, label) in enumerate(license_scan.TEMPLATES)}


def test_many_rules_are_swept_in_portions(spark):
    rng = random.Random(9)
    name = lambda: ".".join(rng.choice(["com", "net", "a", "b"]) for _ in range(rng.randint(1, 4)))
    paths = ["", "/", "/en/", "/en/x", "/e", "/en/xy/z"]
    rules = sorted({(rng.choice(["allow", "block"]), name(), rng.choice(paths)) for _ in range(120)})
    frame = spark.createDataFrame([*rules, ("block", None, "/"), (None, "com", "/")], "verdict string, host string, path string")
    urls = [f"http://{name()}{rng.choice(paths)}" for _ in range(300)] * 2 + [None, ""]
    pages = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = [sorted(map(str, url_rules.judge_urls(pages, frame, max_shipped=n).collect())) for n in (1000, 9)]
    assert found[0] == found[1] and len(found[0]) == len(urls)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "a b ", " ", "a\nb ", "x<|endoftext|>\n", "plain text\nof two lines"])
def test_ids_are_those_of_the_plain_call(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.cached_tokenizer(path("byte_bpe_50k.json")).encode(text), "<u4").tolist() == plain
