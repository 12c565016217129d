"""Collocations beside a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import collocations, word_blocks
from shelfmark.llm.double_array import DoubleArray

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, first):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, *words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    found, out = {}, []
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            found[(lang, *p)] = a
    for (lang, *p), a in found.items():
        cuts = [(2_000_000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
        if not any(o == lang and inside(q) and 100 * b >= 80 * a for (o, *q), b in found.items()):
            out.append((lang, score, a, " ".join(p), f[(lang, *p[:k])], f[(lang, *p[k:])]))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, i + 1, x[3], x[2], x[4], x[5], n[lang], x[1]) for i, x in enumerate(own[:first])]
    return ranked


def texts():
    rng = random.Random(4)
    words = ["the", "of", "New", "york", "city", "é", "ﬁn", "a\x0bb", "x", "Y"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words[:6] if rng.random() < 0.7 else words) + rng.choice([" ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((text + " new york city" * rng.randrange(3), rng.choice(["en", "de", None])))
    return [*rows, (None, "en"), ("", None), (" \t", "fr"), (". . .", "fr"), *[("same text again", "fr")] * 40]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_beside_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(word_blocks, "BLOCK_WORDS", block)  # local workers take it over with the function
    rows = texts()
    docs = spark.createDataFrame([(*r, "z") for r in rows], "text string, lang string, word string")
    for first in (5, 2000):
        found = [tuple(r) for r in collocations.mine_collocations(docs, least=10, first=first).orderBy("lang", "rank").collect()]
        assert found == plain(rows, 10, first)


def test_a_text_over_several_blocks_counts_each_phrase_once():
    text = ("one two three four five. " * 30 + "six " * 25).encode()
    block, codes, seen = word_blocks._Block(), [], Counter()
    for number, part in enumerate(_small_cuts(text)):
        if block.count >= 20:
            codes.append(block.row("b", number > 0))
        block.add(part, "en", number == 0)
    codes.append(block.row("b", False))
    for row in codes:
        names = [None, *row["words"].decode().split(" ")]
        entries = [names[i] for i in np.frombuffer(row["entries"], np.int32)]
        for i in range(len(entries) - row["tail"]):
            for k in range(1, 5):
                if i + k <= len(entries) and None not in entries[i : i + k]:
                    seen[tuple(entries[i : i + k])] += 1
    want = Counter()
    for piece in text.decode().split("."):
        words = piece.split()
        for k in range(1, 5):
            want.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    assert seen == want
    counts = Counter()
    for row in codes:
        for word, n in zip(row["words"].decode().split(" "), np.frombuffer(row["counts"], np.int64)):
            counts[(word,)] += int(n)
    assert {w: n for w, n in counts.items() if n} == {w: n for w, n in want.items() if len(w) == 1}


def _small_cuts(text):
    """As cuts gives them, but short."""
    start = 0
    while start < len(text):
        end = min(len(text), start + 50)
        while end < len(text) and word_blocks.KIND[text[end - 1]] == 0:
            end += 1
        yield text[start:end]
        start = end


def test_cuts_and_hashes_of_very_long_words():
    size = word_blocks.CHUNK
    text = b"a b " + b"x" * (5 * size + 7) + b" tail " + b"y" * (size // 2) + b". end"
    parts = list(word_blocks.cuts(text))
    assert b"".join(parts) == text and len(parts) > 1
    hashes = [h for part in parts for h in word_blocks.word_hashes(np.frombuffer(part, np.uint8))[2].tolist()]
    assert len(hashes) == 6 == len(set(hashes))
    again = word_blocks.word_hashes(np.frombuffer(b"tail x a", np.uint8))[2].tolist()
    assert again[0] == hashes[3] and again[2] == hashes[0]


def test_portions_give_the_same(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "PORTION", 10)
    monkeypatch.setattr(collocations, "PLACES", 20)
    found = [tuple(r) for r in collocations.mine_collocations(docs, least=10).orderBy("lang", "rank").collect()]
    assert found == plain(rows, 10, 2000)


def test_empty(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_double_array():
    rng = np.random.default_rng(1)
    for _ in range(100):
        top, n = int(rng.integers(1, 30)), int(rng.integers(0, 60))
        rows = {(*rng.integers(1, top + 1, k).tolist(), *[0] * (4 - k)) for k in rng.integers(1, 5, n).tolist()}
        rows = np.array(sorted(rows, key=lambda _: rng.random()), np.int64).reshape(-1, 4)
        text = rng.integers(0, top + 3, 300).astype(np.int32)
        found = np.zeros(len(rows), int)
        for _, accepted in DoubleArray(rows).walk(text, 4):
            found += np.bincount(accepted[accepted >= 0], minlength=len(rows))
        phrases = [tuple(w for w in row if w) for row in rows.tolist()]
        assert found.tolist() == [sum(tuple(text[i : i + len(p)].tolist()) == p for i in range(len(text) - len(p) + 1)) for p in phrases]
