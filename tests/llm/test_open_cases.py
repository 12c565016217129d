"""Cases that earlier rounds left open: bridging texts without an id, licenses among telling words, odd column names."""

import random

import pytest

import corpus_pipeline
from shelfmark.llm import jaccard_join, license_scan
from shelfmark.llm.license_scan import OTHERS, TELLING, TEMPLATES, THRESHOLD, words_of



@pytest.mark.parametrize("middle", [2, None])
def test_a_text_without_an_id_links_others(spark, middle):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (middle, " ".join(words[12:])), (3, " ".join(words[24:])), (None, ""), (None, None), (9, "alone"), (None, "alone with no id")]
    found = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_size = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in found}
    assert by_size[(1, 96)] == (1, 1) and by_size[(3, 72)] == (1, 1) and by_size[(middle, 84)] == (1, 2)
    assert by_size[(9, 1)] == (9, 0) and by_size[(None, 1)] == (None, 0) and len(found) == len(rows)


def test_only_texts_without_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join(words[5:])), (None, " ".join(words))]
    found = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.n_links) for r in found) == [(91, 1), (96, 1), (96, 1)] and {r.component_id for r in found} == {None}


def plain_line_labels(line):
    """All templates that a line holds by threshold; of near-equal ones those of the highest rank."""
    block, found = {w for w in words_of(line) if w}, []
    for text, label in TEMPLATES:
        own = {w for w in words_of(text) if w}
        if len(own & block) / len(own) >= THRESHOLD - 1e-9:
            telling = ({w for w in words_of(label)} & own) | (TELLING & own)
            rank = 0 if not telling <= block else 1 if (OTHERS - own) & block else 2
            found.append((label, own, rank))
    near = lambda a, b: len(a & b) >= THRESHOLD * min(len(a), len(b)) - 1e-9
    return {label for label, own, rank in found if not any(r > rank and near(own, o) for _, o, r in found)}, bool(found)


def license_texts():
    rng = random.Random(8)
    more = ["library", "lesser", "sa", "nd", "nc", "This work is free.", "version", "2", "3", "noncommercial", "Use the library as you like."]
    rows = []
    for text, _ in TEMPLATES:
        words = text.split(" ")
        for n in range(12):
            kept = [w for w in words if rng.random() > 0.05 * (n % 4)]
            for _ in range(n // 3):
                kept.insert(rng.choice([0, len(kept)]), rng.choice(more))
            rows.append(" ".join(kept))
    return rows


def test_every_line_over_the_threshold_keeps_a_label(spark):
    """The form that is registered, on lines with telling words."""
    rows = list(enumerate([*license_texts(),
        "This library is licensed under the GNU General Public License, version 3. This work is free.",
        "This is free and unencumbered software released into the public domain. Use the library as you like.",
    ]))
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), phrases=(), ranked=True).collect()}
    for i, text in rows:
        labels, some = plain_line_labels(text)
        own = set(filter(None, found[i].labels.split(",")))
        assert labels <= own, (text, labels, own)
        assert bool(own) >= some and (found[i].score >= THRESHOLD - 1e-9) >= some
    assert found[len(rows) - 2].labels == "gpl-3" and found[len(rows) - 1].labels == "unlicense"


def test_near_duplicates_with_any_column_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, words, 1, 2), (2, words, 3, 4), (None, words, 5, 6)], "doc_id long, text string, `x.y` int, `a``b` int")
    found = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert found.columns == rows.columns and sorted(map(str, (r.doc_id for r in found.collect()))) == ["1", "None"]
