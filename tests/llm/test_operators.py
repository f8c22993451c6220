"""The dealt operators against brute force on small tables."""

import itertools
import random
import textwrap
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tideline.llm import (
    embedding_dedup,
    language_model,
    licences,
    line_dedup,
    mixing,
    neighbours,
    packing,
    queries,
    recurrent,
    sharding,
    simhash,
    toxicity,
)
from tideline.llm.components import connected_components
from tideline.llm.licence_texts import LICENCES, more_licences
from tideline.llm.texts import lane_table

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    draw = random.Random(1)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(300)]
    edges = spark.createDataFrame([*links, (None, 3), (7, None), (9, 9)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    proper = [(a, b) for a, b in links if a != b]
    assert found == roots({n for link in proper for n in link}, proper)


def test_fingerprint_links_equal_brute_force(spark):
    draw = random.Random(2)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            value = centre
            for bit in draw.sample(range(64), draw.randrange(0, 7)):
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["fp"]: r["root"] for r in simhash.link_fingerprints(rows).collect()}
    expected = roots(signed, links)
    groups = {frozenset(n for n in signed if expected[n] == r) for r in set(expected.values())}
    assert {frozenset(n for n in signed if found[n] == r) for r in set(found.values())} == groups


def test_every_pair_of_four_bits_shares_a_key():
    draw = random.Random(3)
    tables = simhash.golay_tables()
    for _ in range(400):
        one = draw.getrandbits(64)
        two = one
        for bit in draw.sample(range(64), 4):
            two ^= 1 << bit
        values = np.array([one, two], dtype=np.uint64).view(np.int64)
        keys, rows = simhash.bucket_keys(values, tables)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_fingerprint_is_the_majority_of_shingle_hashes():
    lanes = lane_table()
    text = "The  Cat sat on\tthe mat, the cat sat on the mat. Ünï " * 90
    words = text.encode().lower().split()
    counts = [0] * 64
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    for shingle in shingles:
        for bit in range(64):
            counts[bit] += xxhash.xxh64_intdigest(shingle, 42) >> bit & 1
    expected = sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))
    assert simhash.fingerprint(text, 4, lanes) % (1 << 64) == expected
    assert simhash.fingerprint("One two", 4, lanes) % (1 << 64) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None, 4, lanes) == simhash.fingerprint(" \n", 4, lanes) == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_permutations_are_exact_and_their_inverse_undoes_them(spark, size):
    from pyspark.sql import functions as F

    rows = spark.range(size).withColumn("n", F.lit(size).cast("long"))
    there = mixing.permuted(rows, "to", F.col("id"), "n", F.lit(5).cast("long"))
    back = mixing.permuted(there, "again", F.col("to"), "n", F.lit(5).cast("long"), inverse=True).collect()
    assert sorted(r["to"] for r in back) == list(range(size))
    assert all(r["again"] == r["id"] for r in back)


def filled(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_weight = sum(weights[s] for s in sizes if s not in full)
        level = rest / open_weight if open_weight else 0
        over = {s for s in sizes if s not in full and weights[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= over


def test_mixing_meets_its_targets(spark):
    draw = random.Random(4)
    names = ["a", "b", "c", "d", "é", None]
    rows = [
        (i, " ".join("w" * draw.randrange(1, 4) for _ in range(draw.choice([0, 1, 5, 40, 300, 2000]))), s)
        for i, s in enumerate(draw.choices(names, [30, 3, 3, 1, 1, 1], k=150))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.taken_words(mixing.mix_sources(docs)).collect()
    sizes, taken = {}, {}
    text = {i: (t, s) for i, t, s in rows}
    for row in found:
        words, source = len(text[row["mix_id"]][0].split()), text[row["mix_id"]][1]
        assert row["mix_size"] == words and 0 <= row["mix_taken"] <= 2 * words
        sizes[source] = sizes.get(source, 0) + words
        taken[source] = taken.get(source, 0) + row["mix_taken"]
    assert len(found) == len(rows)
    targets = filled(sizes)
    for row in found:
        assert row["mix_target"] == pytest.approx(targets[text[row["mix_id"]][1]])
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(7))).collect()
    key = lambda r: (r["mix_id"], r["mix_taken"])
    assert sorted(map(key, again)) == sorted(map(key, found))
    mixed = mixing.mixed_documents(docs).collect()
    words = {}
    for row in mixed:
        words[row["doc_id"]] = words.get(row["doc_id"], 0) + len(row["text"].split())
    assert words == {r["mix_id"]: r["mix_taken"] for r in found if r["mix_taken"]}


def test_shards_are_balanced_and_keep_groups(spark):
    draw = random.Random(5)
    texts = ["x" * draw.randrange(1, 4000) + str(i) for i in range(400)] + ["hot" * 30] * 300 + [None, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sharding.shard_documents(docs, shards=16, task_rows=97).collect()
    bytes_of, slots, shard_of = {}, {}, {}
    for row in found:
        text = texts[row["doc_id"]]
        assert row["size"] == len((text or "").encode()) + 1
        assert row["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert shard_of.setdefault(text, row["shard"]) == row["shard"]
        bytes_of[row["shard"]] = bytes_of.get(row["shard"], 0) + row["size"]
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert len(found) == len(texts) and len(bytes_of) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.02 * sum(bytes_of.values()) / 16


@pytest.mark.parametrize("hot", [0, 3_000_000])
def test_shards_of_many_tasks_are_as_even_as_those_of_one(spark, hot):
    draw = random.Random(6)
    sizes = [int(draw.lognormvariate(7, 1)) + 1 for _ in range(6_000)] + [hot] * bool(hot)
    groups = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "item string, size long")

    def spread(task_rows):
        found = sharding.balanced_groups(groups, 16, task_rows).collect()
        assert sorted(r["item"] for r in found) == sorted(str(i) for i in range(len(sizes)))
        total = [0] * 16
        for r in found:
            total[r["shard"]] += r["size"]
        total = sorted(total)[:-1] if hot else total
        return max(total) - min(total)

    one = spread(10_000)
    assert spread(1_000) <= max(one, 2)


def test_differencing_halves_the_classic_example():
    parts, sizes = sharding.differenced(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    own = parts[:, 0]
    assert sorted(sizes) == [14, 16]
    assert sorted(int(np.array([8, 7, 6, 5, 4])[own == s].sum()) for s in (0, 1)) == [14, 16]


def test_packing_equals_plain_tokens(spark):
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    plain = Tokenizer.from_file(path)
    odd = "é. x, a!, b., Ö, “q”. d×, <|endoftext|> <|ENDOFTEXT|>. THE I'm 3.5, İ K, ẖ. H̱. a\x1cb\x85c　全角。ſt ẞ"
    texts = [odd, None, "", "word " * 9000, *["Same text, here."] * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = packing.pack_documents(docs, path).collect()
    expected = {}
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            expected[i, piece] = (start, ids[start : start + 4096].tobytes())
    assert {(r["doc_id"], r["piece"]): (r["start"], bytes(r["ids"])) for r in found} == expected
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in found)
    whole = packing.sequences(spark.createDataFrame(found)).collect()
    assert all(4 * r["length"] == len(r["ids"]) <= 4 * 4096 for r in whole)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_every_rank_once_without_overlap(seed):
    draw = random.Random(seed)
    capacity = 60
    histogram = {n: draw.randrange(0, 30) for n in range(1, capacity + 1) if draw.random() < 0.5}
    taken, ranks = {}, {}
    for length, low, high, first, per_bin, base in packing.packing_plan(histogram, capacity):
        for rank in range(low, high):
            place = base + (rank - low) % per_bin * length
            taken.setdefault(first + (rank - low) // per_bin, []).append((place, place + length))
            ranks.setdefault(length, []).append(rank)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in itertools.pairwise(spans))


def test_segments_are_all_maximal_ones():
    draw = random.Random(6)
    for _ in range(60):
        scores = np.array([draw.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(draw.randrange(0, 14))])
        best, spans = 0.0, []
        for a in range(len(scores)):
            for b in range(a + 1, len(scores) + 1):
                best = max(best, scores[a:b].sum())
        assert toxicity.best_segment(scores) == pytest.approx(best)
        spans = toxicity.maximal_segments(scores)
        assert max([s for _, _, s in spans], default=0.0) == pytest.approx(best)
        assert all(scores[a:b].sum() == pytest.approx(s) and s > 0 for a, b, s in spans)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(spans))


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    found = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    ones = sorted(r["score"] for r in found if r["toxic"] == 1)
    zeros = sorted(r["score"] for r in found if r["toxic"] == 0)
    wins = sum(np.searchsorted(zeros, s, "left") + np.searchsorted(zeros, s, "right") for s in ones)
    assert wins / (2 * len(ones) * len(zeros)) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert docs.count() == 10_000


def test_licences_in_other_spellings(spark):
    mit = dict(LICENCES)["MIT"]
    other = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;")
    rows = [(1, mit), (2, other), (3, mit + " more"), (4, None), (5, "Text.\nReleased under the  MIT licence!\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan_licences(docs, licences.known_licences(spark)).collect()}
    assert [found[i]["licence"] for i in range(1, 6)] == ["MIT", "MIT", None, None, None]
    assert found[5]["notices"] == ["MIT"] and found[5]["notice_lines"] == 1
    assert found[1]["digest"] == found[2]["digest"] and found[4]["digest"] is None


def test_wrapped_one_line_and_titled_licences(spark):
    titles = {
        "MIT": "The MIT License (MIT)",
        "ISC": "ISC License",
        "BSD-2-Clause": "BSD 2-Clause License",
        "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License',
        "Zlib": "zlib License",
    }
    rows = []
    for name, text in LICENCES:
        copies = [" ".join(text.split()), *["\n".join(textwrap.wrap(text, width, break_long_words=False)) for width in range(14, 100)]]
        copies += [f"{titles[name]}\n\nCopyright (c) 2021, Some One\nAll rights reserved.\n\n{c}" for c in copies]
        copies += [f"{start}\n{text}" for start in ("Copyright 2020 A", "Copyright by A", "© A", "Copyright A Inc. 2019")]
        rows += [(name, copy) for copy in copies]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = licences.scan_licences(docs, licences.known_licences(spark))
    assert found.where("licence is null or licence != doc_id").count() == 0 and found.count() == len(rows)


def test_longer_licences_and_other_notices(spark):
    lines = {
        'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
        "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
        "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "This program is licensed under the GNU GPL v2, or (at your option) any later version.": "GPL-2.0-or-later",
        "Licensed under the GNU Affero General Public Licence, version 3": "AGPL-3.0-only",
        "Released under CC BY-SA 3.0": "CC-BY-SA-3.0",
        "This file is released under the MPL 2.0.": "MPL-2.0",
    }
    texts = {name: text.replace("\n", "\n ") for name, text in more_licences()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    docs = spark.createDataFrame([(text, text) for text in [*lines, *texts.values()]], "doc_id string, text string")
    known = licences.known_licences(spark, licences.all_licences())
    found = {r["doc_id"]: r for r in licences.scan_licences(docs, known).collect()}
    assert {line: found[line]["notices"] for line in lines} == {line: [name] for line, name in lines.items()}
    assert {name: found[text]["licence"] for name, text in texts.items()} == {name: name for name in texts}


def edit_similarity(one, two):
    row = list(range(len(two) + 1))
    for i, a in enumerate(one, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(two, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return 1 - row[-1] / max(len(one), len(two))


def test_the_piece_filter_keeps_every_similar_pair():
    draw = random.Random(8)
    ones, twos = [], []
    for _ in range(400):
        line = "".join(draw.choice("abcde é") for _ in range(draw.randrange(1, 300)))
        other = list(line)
        for _ in range(draw.randrange(0, max(1, len(line) // 3))):
            at = draw.randrange(len(other) + 1)
            other[at : at + draw.randrange(2)] = draw.choice(["", "x", "a"])
        ones.append(line)
        twos.append("".join(other) or "x")
    ones += [f"{i} is a line of its own with number {i * i}" for i in range(100)]
    twos += ["".join(draw.choice("abcdefghij ") for _ in range(40)) for _ in range(100)]
    fits = line_dedup.piece_filter(ones, twos, 0.8)
    near = [line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in zip(ones, twos, strict=True)]
    assert near == [line_dedup.near_pair(a, b, 0.8) for a, b in zip(ones, twos, strict=True)]
    assert near == line_dedup.near_pairs(ones, twos, 0.8).tolist()
    assert line_dedup.near_pairs(["é" * 5_000, "", "漢字"], ["é" * 4_500, "", "字"], 0.8).tolist() == [True, True, False]
    assert not len(line_dedup.near_pairs([], [], 0.8))
    for a, b in zip(ones, twos, strict=True):
        assert line_dedup.edits_found(a, b, 10_000) >= line_dedup.edit_distance(a, b)
    assert sum(near) > 100 and not (np.array(near) & ~fits).any()
    assert not fits[-100:].any()


def test_line_groups_equal_brute_force(spark):
    draw = random.Random(7)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 11))) for _ in range(3000)]
    lines = []
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.randrange(12, 40))
        lines.append(" ".join(words))
        for _ in range(draw.randrange(0, 3)):
            changed = list(words)
            changed[draw.randrange(len(words))] = draw.choice(vocabulary)
            lines.append(" ".join(changed) + draw.choice(["", ".", "!"]))
    draw.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [lines[0].upper() + "\n--\n--", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    table = line_dedup.plain_bytes()
    places = [
        (i, n, b" ".join(words).decode())
        for i, text in enumerate(texts)
        if text is not None
        for n, words in enumerate(line_dedup.plain_lines(text, table))
        if words
    ]
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(places)), 2)
        if places[a][2] == places[b][2]
        or abs(len(places[a][2]) - len(places[b][2])) < 40
        and len(set(places[a][2].split()) & set(places[b][2].split())) > 5
        and edit_similarity(places[a][2], places[b][2]) >= 0.8
    ]
    root = roots(range(len(places)), links)
    gone = {(places[n][0], places[n][1]) for n, r in root.items() if n != r}
    got = {(i, n) for i, r in found.items() for n in r["removed_lines"]}
    assert got <= gone and len(got) >= 0.95 * len(gone)
    for i, text in enumerate(texts):
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in got)
        assert found[i]["text"] == kept


def removed(spark, lines):
    """The numbers of the lines that are taken out, each line being a document."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"] for r in line_dedup.dedup_lines(docs).where("size(removed_lines) > 0").collect()}


def test_short_lines_equal_brute_force(spark):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("abcdefghijklmnopé", k=draw.randrange(2, 11))) for _ in range(400)]
    lines = []
    for _ in range(150):
        line = " ".join(draw.choices(vocabulary, k=draw.randrange(1, 8)))[: line_dedup.SHORT].strip()
        lines.append(line)
        letters = list(line)
        for _ in range(draw.randrange(1, len(line) // 4 + 2)):
            at = draw.randrange(len(letters) + 1)
            letters[at : at + draw.randrange(2)] = draw.choice(["", "x", "y"])
        lines.append("".join(letters).strip() or "z")
    plain = [" ".join(line.split()) for line in lines]
    pairs = itertools.combinations(range(len(lines)), 2)
    links = [(a, b) for a, b in pairs if edit_similarity(plain[a], plain[b]) >= 0.8 - 1e-9]
    gone = {n for n, r in roots(range(len(lines)), links).items() if n != r}
    assert gone and removed(spark, lines) == gone


def test_long_lines_that_meet_are_compared_whatever_their_bits(spark):
    draw = random.Random(12)
    table, lanes = line_dedup.plain_bytes(), lane_table()
    while True:
        words = ["".join(draw.choices("abcdefghijklmnop", k=k)) for k in [8] * 7 + [2] * 6]
        changed = words[:8] + ["".join(draw.choices("qrstuvw", k=2)) for _ in range(5)]
        one, two = " ".join(words), " ".join(changed)
        prints = [line_dedup.LineTable([x], table).prints(lanes)[0] for x in (one, two)]
        differ = int(prints[0] ^ prints[1]) & (2**64 - 1)
        meet = any(not differ >> 8 * block & 255 for block in range(8))
        if meet and differ.bit_count() > 16 and min(len(one), len(two)) > 64 and edit_similarity(one, two) >= 0.8:
            break
    assert removed(spark, [one, two]) == {1}


def test_neighbours_reach_the_recall(spark):
    vectors = queries.table(spark, MIDDLE, "embeddings")
    rows = vectors.collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = {}
    for r in queries.op10_nearest_neighbours(spark, MIDDLE).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = ids[ids % 20 == 0]
    assert sorted(found) == sorted(asked)
    hits = 0
    for query in asked:
        scores = points @ points[ids == query][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        hits += len({i for i, _ in found[query]} & set(ids[order]))
        assert len(found[query]) == 20
        assert all(s == pytest.approx(scores[ids == i][0], abs=1e-12) for i, s in found[query])
    assert hits >= 0.9 * 20 * len(asked)


def recall(found, ids, points, asked, most):
    hits = 0
    for query in asked:
        scores = points @ points[ids == query][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:most]
        hits += len(set(found[query]) & set(ids[order].tolist()))
    return hits / (most * len(asked))


def test_neighbours_of_several_shards(spark):
    draw = np.random.default_rng(8)
    points = draw.standard_normal((6_000, 24)) + 2 * draw.standard_normal((30, 24))[draw.integers(30, size=6_000)]
    ids = np.arange(6_000)
    vectors = spark.createDataFrame(list(zip(ids.tolist(), points.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=1_200).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert recall(found, ids, points, ids[ids % 20 == 0].tolist(), 20) >= 0.95


def test_a_graph_built_by_walks_reaches_every_node():
    draw = np.random.default_rng(9)
    points = draw.standard_normal((3_000, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = neighbours.SmallWorld(points)
    for at, table in enumerate(graph.links):
        assert table.max() < len(table) and not (table == np.arange(len(table))[:, None]).any(), at
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in table), at
    found = graph.search(points, 1)[:, 0]
    assert (found == np.arange(3_000)).mean() >= 0.999
    assert neighbours.SmallWorld(points[:0]).search(points[:3], 2).tolist() == [[-1, -1]] * 3
    assert neighbours.SmallWorld(points[:1]).search(points[:1], 2).tolist() == [[0, -1]]


def test_equal_and_longer_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [3.0, 0.1]), (101, [-1.0, 0.0]), (102, [0.0, 0.0])]
    rows += [(103, None), (104, [float("nan"), 1.0]), (105, [None, 1.0]), (None, [9.0, 9.0]), (100, [3.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id in (0, 101, 102)")
    found = neighbours.nearest(vectors, asked, most=5).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == 0] == [
        (100, 3.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0),
    ]
    assert [r["vec_id"] for r in found if r["query_id"] == 101] == [0, 1, 2, 3, 4]
    assert {r["query_id"] for r in found} == {0, 101}


def test_embedding_links_equal_brute_force(spark):
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((20, 32))
    rows = []
    for i in range(300):
        point = centres[i % 20] + draw.standard_normal(32) * draw.choice([0.02, 0.1, 0.14, 3.0])
        rows.append((i, [float(x) for x in point * draw.choice([1, 5])], int(i % 2) if i % 7 else None))
    rows += [(300 + i, rows[1][1], rows[1][2]) for i in range(40)] + [(400, [0.0] * 32, 1), (401, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in embedding_dedup.embedding_components(vectors).collect()}
    links = []
    able = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if k is not None and v is not None and any(v)]
    for (i, v, k), (j, w, m) in itertools.combinations(able, 2):
        if k == m and v @ w >= 0.98:
            links.append((i, j))
    expected = roots([i for i, _, _ in rows], links)
    counts = {i: 0 for i, _, _ in rows}
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    assert {i: r["n_links"] for i, r in found.items()} == counts
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_class_probabilities_add_up_to_one():
    shape = recurrent.Shape(12, (0, 1, 4), 3)
    weights = recurrent.initial(shape, np.arange(15.0), hidden=4)
    weights["word"] += np.random.default_rng(1).standard_normal(weights["word"].shape).astype(np.float32)
    states = np.repeat(np.random.default_rng(2).standard_normal((1, 4)).astype(np.float32), 15, axis=0)
    total = np.exp(recurrent.log_probabilities(weights, shape, states, np.arange(15))).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_gradients_equal_differences():
    shape = recurrent.Shape(6, (0, 2), 2)
    weights = {k: v.astype(np.float64) for k, v in recurrent.initial(shape, np.ones(8), hidden=3).items()}
    states = np.random.default_rng(3).standard_normal((10, 3))
    targets = np.random.default_rng(4).integers(0, 8, 10)
    grads, back = recurrent._output_gradients(weights, shape, states, targets)

    def loss():
        return -recurrent.log_probabilities(weights, shape, states, targets).mean()

    for name in ("class", "class_bias", "word_bias"):
        at = (0,) * weights[name].ndim
        before = loss()
        weights[name][at] += 1e-5
        assert (loss() - before) / 1e-5 == pytest.approx(grads[name][at], abs=1e-4)
        weights[name][at] -= 1e-5
    before = loss()
    states[0, 0] += 1e-5
    assert (loss() - before) / 1e-5 == pytest.approx(back[0, 0], abs=1e-4)


def test_carried_state_makes_blocks_of_no_matter():
    shape = recurrent.Shape(6, (0, 2), 2)
    weights = recurrent.initial(shape, np.ones(8), hidden=3)
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 8, n) for n in (1, 3, 40_000, 7, 100)]
    together = recurrent.score(weights, shape, texts, 0)
    alone = [recurrent.score(weights, shape, [text], 0)[0] for text in texts]
    assert together == pytest.approx(alone, rel=1e-4)


def test_language_model_scores(spark):
    found = queries.op8_language_model(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SMALL, "documents").collect()}
    split = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = {}
    for i, words in split.items():
        if not out[i]:
            for word in words:
                counts[word] = counts.get(word, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    assert len(found) == len(texts)
    for r in found:
        words = split[r["doc_id"]]
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(words), total)
        assert r["n_known"] == sum(w in counts for w in words)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.held_out is not None


def test_the_network_learns_from_every_training_document(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(7, "text 7")] * 50, "doc_id long, text string")
    model, _ = language_model.fit_language_model(docs, F.lit(True))
    coded = language_model._coded(docs, model.outputs, 8, "text").collect()
    assert len(coded) == 450
    numbers = language_model.numbers_of(model.outputs)
    end = model.outputs[language_model.hashed(b"")]
    expected = sorted([numbers[b"text"], numbers[str(i).encode()], end] for i in [*range(400), *[7] * 50])
    assert sorted(np.frombuffer(r["tokens"], dtype=np.uint16).tolist() for r in coded) == expected
    same = {r["shard"] for r in coded if np.frombuffer(r["tokens"], dtype=np.uint16)[1] == numbers[b"7"]}
    assert len(same) > 4  # rows that repeat a document are spread


def test_every_token_of_a_shard_is_trained_on(monkeypatch):
    monkeypatch.setattr(recurrent, "STREAM_WINDOWS", 1)
    shape = recurrent.Shape(6, (0, 2), 2)
    draw = np.random.default_rng(5)
    trainer = recurrent.Trainer(recurrent.initial(shape, np.ones(8), hidden=3), shape, 0)
    for size in (1, 5, 1000, 777, 3):
        trainer.segment(draw.integers(0, 8, size))
    trainer.finish()
    assert trainer.tokens == 1786 and not len(trainer.left)


def test_training_in_a_tree_of_averages(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 40)
    monkeypatch.setattr(language_model, "FAN_IN", 3)
    monkeypatch.setattr(language_model, "SEGMENT_TOKENS", 64)
    docs = spark.createDataFrame([(i, f"a b c {i % 5} " * 4) for i in range(40)], "doc_id long, text string")
    model, counts = language_model.fit_language_model(docs, F.lit(True))
    assert all(np.isfinite(w).all() for w in model.weights.values())
    one = docs.limit(1)
    score = language_model.score_documents(one, model, counts).first()
    assert score["score"] > score["base_score"]


def test_averages_weigh_tokens(spark):
    rows = [(0, 0, 1, [1.0, 2.0]), (0, 0, 3, [5.0, 2.0]), (1, 0, 2, [4.0])]
    frame = spark.createDataFrame(rows, "block int, part int, tokens long, weights array<float>")
    assert sorted(tuple(r) for r in language_model._averaged(frame).collect()) == [(0, 0, 4, [4.0, 2.0]), (1, 0, 2, [4.0])]


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0)]
    rows += [(4, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 1.0], 1), (5, [0.0, 0.01, 1.0], 1), (5, [0.0, 0.01, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(tuple(r) for r in embedding_dedup.embedding_components(vectors).collect())
    expected = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    expected += [(4, 0, 4, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False)]
    assert found == expected


def test_links_at_the_bound(spark):
    """A cosine of exactly the bound links, and a bound of the next larger double does not."""
    rows = [(7, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (9, [3.0, 4.0], 0), (11, [-1.0, 0.0], 0), (5, [-4.0, -3.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def found(bound):
        return {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_components(vectors, bound).collect()}

    apart = {11: (1, 5, False), 5: (1, 5, True)}
    assert found(0.6) == {7: (2, 3, False), 3: (2, 3, True), 9: (2, 3, False)} | apart
    assert found(np.nextafter(0.6, 1)) == {7: (1, 3, False), 3: (1, 3, True), 9: (0, 9, True)} | apart


def test_labelled_rows_bound_what_is_learned(spark):
    docs = queries.table(spark, MIDDLE, "documents")
    labels = queries.table(spark, MIDDLE, "labels")
    every = toxicity.fit_toxicity(docs, labels)
    some = toxicity.fit_toxicity(docs, labels, labelled_rows=150)
    assert every.grams and 0 < len(some.grams) < len(every.grams)


def test_licences_and_their_sql_follow_one_rule(spark, tmp_path):
    """Titled, re-wrapped, dated and unknown texts, in both engines."""
    import duckdb

    from tideline.llm.oracle import LLM_ORACLE

    texts = []
    for name, text in [*LICENCES, *more_licences()]:
        texts += [text, f"The {name} License\n\n{text}", textwrap.fill(text, 61), " ".join(text.split()), text.upper()]
        texts += [f"Copyright (c) 2019 Some Body\n{text}", f"{text}\nand one more condition", text.replace("license", "licence")]
    texts += ["Copyright treaty of 1996 applies", "copyright holders 2001 said so", "© me\nAll rights reserved.", "", None, " \n", "MIT License"]
    texts += ["This work is released under the terms of the MIT License.\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: 0BSD"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_licences(spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = connection.execute(LLM_ORACLE["op5_licences"])
    names = [c[0] for c in cursor.description]
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(cursor.fetchall(), key=repr)
    assert sum(r["licence"] is not None for r in found) > 5 * len(LICENCES)
