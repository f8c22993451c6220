"""Suffix arrays and repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import queries, repeats
from tideline.llm.suffix_array import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def check_array(letters):
    text = np.append(np.array(letters, dtype=np.uint16) + 1, np.uint16(0))
    plain = text.tolist()
    expected = sorted(range(len(plain)), key=lambda i: plain[i:])
    array = suffix_array(text)
    assert array.tolist() == expected
    prefixes = permuted_prefixes(text, array)
    for before, own in zip(expected, expected[1:], strict=False):
        common = 0
        while max(before, own) + common < len(plain) and plain[before + common] == plain[own + common]:
            common += 1
        assert prefixes[own] == common


def test_arrays_equal_sorting():
    draw = random.Random(1)
    for size in range(0, 300, 2):
        letters = draw.choice([1, 2, 3, 5, 250])
        check_array([draw.randrange(letters) for _ in range(size)])
    base = [draw.randrange(4) for _ in range(60)]
    for text in ([0] * 200, [0, 1] * 90, [1, 0, 0] * 50 + [2] * 30, base * 7 + [9] + base * 3, list(range(200)), list(range(200, 0, -1))):
        check_array(text)


def brute(texts, length):
    """(n_bytes, spans, kept) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        covered = np.zeros(len(d) + 2, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i + 1] += 1
                covered[i + 1 + length] -= 1
        flags = (np.cumsum(covered)[: len(d) + 1] > 0).astype(int)[1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
        kept = bytes(b for b, f in zip(d, flags, strict=True) if not f)
        found.append((len(d), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], kept))
    return found


def texts(seed, many=60):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 8))) for _ in range(80)]
    passages = [" ".join(draw.choices(words, k=draw.randrange(5, 40))) for _ in range(6)]
    found = []
    for _ in range(many):
        parts = [" ".join(draw.choices(words, k=draw.randrange(0, 40))) for _ in range(draw.randrange(1, 4))]
        if draw.random() < 0.5:
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages))
        found.append(" ".join(parts))
    found += draw.choices(found, k=6)
    for text in draw.choices(found, k=8):
        at = draw.randrange(len(text) + 1)
        found.append(text[:at] + "X" + text[at + 1 :])
    return found


def result(spark, rows, length):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "key", "kept", "start", "runs")})
    found = repeats.without_repeats(docs, length).collect()
    assert all(r["digest"] == "x" for r in found)
    return Counter(
        (r["doc_id"], r["text"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept"])) for r in found
    )


def expected(rows, length):
    return Counter(
        (i, t, tuple(spans), kept) for (i, t), (_, spans, kept) in zip(rows, brute([t for _, t in rows], length), strict=True)
    )


@pytest.mark.parametrize("length", [8, 20, 50])
def test_equals_brute_force(spark, length):
    rows = list(enumerate(texts(length)))
    assert result(spark, rows, length) == expected(rows, length)


@pytest.mark.parametrize("name,value", [("CROWDED_BYTES", 100), ("CROWDED_BYTES", 2_000), ("SHARD_BYTES", 300), ("CONTEXT_WINDOWS", 8), ("TEXT_WINDOWS", 50)])
def test_keys_of_many_contexts_and_cut_texts(spark, monkeypatch, name, value):
    monkeypatch.setattr(repeats, name, value)
    rows = list(enumerate(texts(7)))
    rows += [(1000 + i, "a" * (40 + 13 * i) + "bc" * i) for i in range(8)]
    assert result(spark, rows, 24) == expected(rows, 24)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "short"), (3, "long " * 2_000), (4, "é" * 300), (4, "é" * 300), (5, "xyz" + "\0" * 50), (6, "q")]
    rows += [(None, "a text that is there once only, and longer than the length")]
    assert result(spark, rows, 32) == expected(rows, 32)
    assert result(spark, [], 32) == Counter()


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = brute([r["text"] for r in docs], 400)
    found = {r["doc_id"]: r for r in queries.op12_suffix_array(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs) and any(spans for _, spans, _ in rows)
    for doc, (size, spans, kept) in zip(docs, rows, strict=True):
        r = found[doc["doc_id"]]
        removed = sum(b - a for a, b in spans)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (size, removed, len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
