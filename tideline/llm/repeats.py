"""Operator 12: byte strings that occur twice, by suffix arrays over shards of contexts.

Every window of ``length`` bytes has a key: the least hash of the grams inside it. Windows
that are equal have equal keys, and neighbouring windows mostly share theirs, so a text falls
into runs of windows of one key. Runs whose key occurs once hold no repeated window and go no
further. The bytes of the others (contexts) are gathered by key into shards of bounded size;
a shard's suffix array is made by induced sorting, and windows next to each other in it whose
common prefix has ``length`` bytes are repeated. A window has one key, so it is looked for
in one shard, and what is found there is all there is.

Equal contexts are gathered once. A key whose different contexts would not fit into a shard is
split: its windows are hashed (128 bits) and counted one by one, added up before the shuffle.
Hashes choose what is compared; only windows of such a key, and whole texts, are equal by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.suffix_array import permuted_prefixes, suffix_array
from tideline.plans.storage import Scratch

LENGTH = 400
#: Windows that a context has at most, and windows of a text that are hashed at once.
CONTEXT_WINDOWS = 1 << 14
TEXT_WINDOWS = 1 << 20
#: Bytes of a shard on average, and of a key's different contexts at most.
SHARD_BYTES = 1 << 20
CROWDED_BYTES = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WindowHashes:
    """Hashes of all strings of one length inside a text, from running sums modulo 2 ** 64."""

    def __init__(self, length: int, base: int):
        self.length, self.base = length, base
        self.letters = np.random.default_rng(base).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data):
            inverse = pow(self.base, -1, 1 << 64)
            ones = np.ones(1, dtype=np.uint64)
            self.powers = np.concatenate([ones, np.cumprod(np.full(len(data), self.base, dtype=np.uint64))])
            self.inverses = np.concatenate([ones, np.cumprod(np.full(len(data), inverse, dtype=np.uint64))])
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        found = (sums[self.length :] - sums[: -self.length]) * self.inverses[: len(data) - self.length + 1]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        return found ^ found >> np.uint64(29)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row: running minima from both ends of blocks."""
    count = len(values)
    blocks = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:count] = values
    blocks = blocks.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[: count - width + 1], before[width - 1 : count])


def key_runs(data: np.ndarray, length: int, hashes: WindowHashes) -> tuple[np.ndarray, ...]:
    """(start, windows, key, twice) of the runs of windows of one key, cut to CONTEXT_WINDOWS.

    ``twice`` holds where the least gram may occur again within the run, as in periodic text.
    """
    starts, keys, twice = [], [], []
    total, width = len(data) - length + 1, length - hashes.length + 1
    for at in range(0, total, TEXT_WINDOWS):
        end = min(at + TEXT_WINDOWS, total)
        grams = hashes(data[at : end + length - 1])
        least = _least(grams, width)
        # A gram is the least of some window if it equals the largest key of the windows around it.
        around = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
        around[width - 1 : width - 1 + len(least)] = least
        chosen = np.flatnonzero(~_least(~around, width) == grams)
        values = grams[chosen]
        again = values[1:][(values[1:] == values[:-1]) & (np.diff(chosen) <= width)]
        new = np.diff(least, prepend=~least[:1]) != 0
        firsts = np.flatnonzero(new)
        since = np.arange(len(least)) - np.repeat(firsts, np.diff(np.append(firsts, len(least))))
        firsts = np.flatnonzero(new | (since % CONTEXT_WINDOWS == 0))
        starts.append(firsts + at)
        keys.append(least[firsts])
        twice.append(np.isin(keys[-1], again))
    start = np.concatenate(starts)
    return start, np.diff(np.append(start, total)), np.concatenate(keys).view(np.int64), np.concatenate(twice)


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, whether each of its windows occurs at another place of these contexts."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    text = np.append(text, np.uint16(0))
    firsts = ends - sizes
    inside = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(inside, firsts, 1)
    np.add.at(inside, ends - length + 1, -1)
    windows = np.cumsum(inside[:-1]) > 0
    array = suffix_array(text)
    common = permuted_prefixes(text, array)[array]
    places = np.flatnonzero(windows[array])
    found = np.zeros(len(text), dtype=bool)
    if len(places) > 1:
        shared = np.minimum.reduceat(common[: places[-1] + 1], places[:-1] + 1) >= length
        found[array[places[:-1][shared]]] = True
        found[array[places[1:][shared]]] = True
    return [found[a : a + n - length + 1] for a, n in zip(firsts, sizes, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256))


def _runs(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(digest, start, windows, key, twice) of every text of at least ``length`` bytes."""
    gram = max(1, length // 4)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WindowHashes(gram, _BASES[0])
        for batch in batches:
            found = [key_runs(np.frombuffer(t, dtype=np.uint8), length, hashes) for t in batch["text"]]
            if found:
                many = [len(f[0]) for f in found]
                names = ("start", "windows", "key", "twice")
                columns = {n: np.concatenate(parts) for n, parts in zip(names, zip(*found, strict=True), strict=True)}
                yield pd.DataFrame({"digest": np.repeat(batch["digest"].to_numpy(), many), **columns})

    texts = docs.where(F.octet_length(text_col) >= length).select(
        _digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text")
    )
    return texts.mapInPandas(runs, "digest binary, start long, windows long, key long, twice boolean")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(digest, start, key, twice, context, bytes) of the runs of each text; copies of a text in a row count once."""

    names = ["digest", "start", "key", "twice", "context", "bytes"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for digest, text, runs in zip(batch["digest"], batch["text"], batch["runs"], strict=True):
                if digest == last:
                    continue
                last = digest
                for run in runs:
                    part = text[run["start"] : run["start"] + run["windows"] + length - 1]
                    context = hashlib.blake2b(part, digest_size=16).digest()
                    rows.append((digest, run["start"], run["key"], run["twice"], context, part))
                    held += len(part)
                if held > 1 << 24:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(cut, "digest binary, start long, key long, twice boolean, context binary, bytes binary")


def _found_in_shards(contexts: DataFrame, shards: int, length: int) -> DataFrame:
    """(key, context, from, to): repeated windows of the contexts, by the suffix array of each shard."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_windows(list(shard["bytes"]), length)
        rows = [
            (key, context, a, b)
            for key, context, shared, found in zip(shard["key"], shard["context"], shard["shared"], flags, strict=True)
            if not shared
            for a, b in _ranges(found)
        ]
        return pd.DataFrame(rows, columns=["key", "context", "from", "to"])

    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "key long, context binary, from long, to long")


def _found_by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with many contexts: their windows counted by 128 bits of hash."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = (WindowHashes(length, base) for base in _BASES)
        for batch in batches:
            for key, context, data in zip(batch["key"], batch["context"], batch["bytes"], strict=True):
                letters = np.frombuffer(data, dtype=np.uint8)
                first = one(letters).view(np.int64)
                yield pd.DataFrame(
                    {"h1": first, "h2": two(letters).view(np.int64), "key": key, "context": context, "at": np.arange(len(first))}
                )

    windows = contexts.mapInPandas(hashed, "h1 long, h2 long, key long, context binary, at long")
    counts = windows.groupBy("h1", "h2").agg(F.count("*").alias("many")).where("many > 1")
    again = windows.join(counts, ["h1", "h2"]).groupBy("key", "context").agg(F.collect_list("at").alias("places"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, context, places in zip(batch["key"], batch["context"], batch["places"], strict=True):
                flags = np.zeros(max(places) + 1, dtype=bool)
                flags[places] = True
                rows += [(key, context, a, b) for a, b in _ranges(flags)]
            yield pd.DataFrame(rows, columns=["key", "context", "from", "to"])

    return again.mapInPandas(joined, "key long, context binary, from long, to long")


def _spans(ranges: DataFrame, length: int) -> DataFrame:
    """(digest, removed): the bytes that the windows of each text cover, as maximal spans."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for found in batch["found"]:
                ordered = sorted((r["a"], r["b"] + length - 1) for r in found)
                one: list[list[int]] = []
                for a, b in ordered:
                    if one and a <= one[-1][1]:
                        one[-1][1] = max(one[-1][1], b)
                    else:
                        one.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in one])
            yield pd.DataFrame({"digest": batch["digest"], "removed": spans})

    texts = ranges.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    return texts.mapInPandas(merged, f"digest binary, removed {SPANS}")


SPANS = "array<struct<start:bigint,end:bigint>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(digest, removed) of every different text with repeated bytes; digest is its SHA-256."""
    scratch = Scratch(docs.sparkSession)
    runs = scratch.write(_runs(docs, text_col, length), "runs")
    alone = (F.count("*") == 1) & ~F.bool_or("twice")
    repeated = runs.groupBy("key").agg(alone.alias("alone")).where("NOT alone").select("key")
    met = runs.join(repeated, "key").groupBy("digest").agg(
        F.collect_set(F.struct("start", "windows", "key", "twice")).alias("runs"),
        F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("copies"),
        F.max(F.col("start") + F.col("windows")).alias("end"),
    )
    met = scratch.write(met, "texts")
    scratch.drop("runs")
    texts = docs.where(F.octet_length(text_col) >= length).select(
        _digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text")
    )
    found = scratch.write(_contexts(texts.join(met.select("digest", "runs"), "digest"), length), "contexts")
    place = F.struct("digest", "start")
    different = found.groupBy("key", "context").agg(
        F.any_value("bytes").alias("bytes"),
        (F.min(place) != F.max(place)).alias("shared"),
        F.bool_or("twice").alias("twice"),
    )
    different = scratch.write(different, "different")
    open_ = (F.count("*") > 1) | F.bool_or(F.col("twice") & ~F.col("shared"))
    sizes = different.groupBy("key").agg(open_.alias("open"), F.sum(F.octet_length("bytes")).alias("size"))
    sizes = scratch.write(sizes.where("open"), "sizes")
    total = sizes.where(F.col("size") <= CROWDED_BYTES).agg(F.sum("size")).first()[0] or 0
    keyed = different.join(sizes, "key")
    pooled = _found_in_shards(keyed.where(F.col("size") <= CROWDED_BYTES), max(1, -(-total // SHARD_BYTES)), length)
    crowded = _found_by_windows(keyed.where(F.col("size") > CROWDED_BYTES), length)
    whole = different.where("shared").select(
        "key", "context", F.lit(0).cast("long").alias("from"), (F.octet_length("bytes") - length + 1).cast("long").alias("to")
    )
    windows = scratch.write(pooled.union(crowded).union(whole), "windows")
    scratch.drop("different", "sizes")
    ranges = found.select("digest", "start", "key", "context").join(windows, ["key", "context"])
    ranges = ranges.select("digest", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to")).alias("b"))
    copies = met.where("copies > 1").select("digest", F.lit(0).cast("long").alias("a"), F.col("end").alias("b"))
    spans = scratch.write(_spans(ranges.union(copies), length), "spans")
    scratch.drop("texts", "contexts", "windows")
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """Every row with ``removed`` (spans of bytes) and ``kept`` (the other bytes of the text).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this
    text or another; overlapping places count, and all of them go. Texts are taken as UTF-8 bytes, so
    ``kept`` may cut a letter. A null text is an empty one; texts shorter than ``length`` are
    kept whole. Rows that repeat a text repeat all its bytes. Ids are not looked at. An empty table
    gives an empty one; other columns stay as they are, but for columns named removed or kept.
    """
    spans = repeated_spans(docs, length, text_col).withColumnRenamed("digest", "__digest").withColumnRenamed("removed", "__removed")
    rows = docs.drop("removed", "kept").withColumn("__digest", _digest(text_col)).join(spans, "__digest", "left")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("__removed.end"))
    ends = F.concat(F.col("__removed.start"), F.array(F.octet_length(data).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))))
    kept = F.when(F.col("__removed").isNull(), data).otherwise(F.unhex(F.array_join(pieces, "")))
    removed = F.coalesce("__removed", F.array().cast(SPANS))
    return rows.withColumns({"removed": removed, "kept": kept}).drop("__digest", "__removed")
