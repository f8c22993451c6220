"""Operator 7: SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21 bits, each read as
a word of the perfect binary Golay code (23, 12, 7), high bits zero. A segment's
*fuzzy* keys are the 12-bit indices of all codewords at distance 4 or less: one
for a word at distance 2 or less from its codeword, six for the others. Two words
at distance 2 or less share a fuzzy key: a word midway between them has a
codeword at distance 3 or less, which is at distance 4 or less from both.

Pigeonhole for at most 4 differing bits in all:

* if some segment is equal, one of the others differs in at most 2 bits: one key
  for each ordered pair (equal segment, fuzzy segment), 33 or 34 bits;
* else every segment differs, two of them in exactly one bit, so one half of each
  of these is equal, and the third in at most 2: one key for each choice of the
  fuzzy segment and of two halves, 33 or 34 bits.

So every linked pair shares a key, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.texts import lane_table, majority
from tideline.plans.storage import remove, shared_folder, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the Golay code.
GENERATOR = 0b101011100011
MAX_BITS = 4
#: Texts, and fingerprints with their about 96 keys each, that a task turns into a batch at once.
TEXTS, PRINTS = 1_024, 512
#: Fingerprints whose keys one task makes.
TASK_PRINTS = 8_192


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(check bits by message, the error patterns of weight 4 or less by syndrome).

    Patterns come in rows of six; a syndrome with a single one repeats it.
    """
    checks = np.zeros(1 << 12, dtype=np.int64)
    for message in range(1 << 12):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        checks[message] = rest
    words = np.arange(1 << 23, dtype=np.int64)
    weights = np.bitwise_count(words)
    light = words[weights <= 4]
    syndromes = checks[light >> 11] ^ (light & 0x7FF)
    order = np.lexsort((light, np.bitwise_count(light), syndromes))
    light, syndromes = light[order], syndromes[order]
    starts = np.searchsorted(syndromes, np.arange(1 << 11))
    found = np.bincount(syndromes, minlength=1 << 11)
    column = np.minimum(np.arange(6), found[:, None] - 1)
    return checks, light[starts[:, None] + column]


def fuzzy_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(12-bit indices, which of them count), six for each word."""
    checks, patterns = tables
    errors = patterns[checks[words >> 11] ^ (words & 0x7FF)]
    several = errors[:, 1] != errors[:, 0]
    counts = np.repeat(several[:, None], 6, axis=1)
    counts[:, 0] = True
    return (words[:, None] ^ errors) >> 11, counts


def bucket_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint) for every key of the fingerprints."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    fuzzy = [fuzzy_keys(part, tables) for part in parts]
    halves = [(part >> 11, part & 0x7FF) for part in parts]
    keys, rows, table = [], [], 0
    position = np.repeat(np.arange(len(prints))[:, None], 6, axis=1)

    def add(exact: np.ndarray, third: int) -> None:
        nonlocal table
        near, counts = fuzzy[third]
        key = (np.int64(table) << 40) | (exact[:, None] << 12) | near
        keys.append(key[counts])
        rows.append(position[counts])
        table += 1

    for third in range(3):
        one, two = (i for i in range(3) if i != third)
        add(parts[one], third)
        add(parts[two], third)
        for a in halves[one]:
            for b in halves[two]:
                add((a << 11) | b, third)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: str | None, shingle: int, lanes: np.ndarray) -> int:
    """SimHash of the word shingles of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return majority(np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64), lanes)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(starts),
    )
    return majority(hashes, lanes)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row of the documents."""
    lanes = lane_table()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = (fingerprint(text.as_py(), shingle, lanes) for text in part.column(1))
                values = pa.array(np.fromiter(found, np.int64, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), values], [id_col, "fp"])

    columns = docs.select(id_col, text_col)
    kind = columns.schema[id_col].dataType.simpleString()
    return columns.mapInArrow(prints, f"`{id_col}` {kind}, fp long")


def _bucketed(prints: DataFrame) -> DataFrame:
    tables = golay_tables()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), PRINTS):
                part = values[at : at + PRINTS]
                found, rows = bucket_keys(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["key", "fp"])

    # A fingerprint is a few bytes in a file and about 96 keys in a task, so tasks are cut by fingerprints, and keys are dealt anew from two on.
    dealt = prints.select("fp").repartition(max(2, -(-prints.count() // TASK_PRINTS)), "fp")
    return dealt.mapInArrow(keys, "key long, fp long")


def _near(one: str, two: str, max_bits: int):
    return F.bit_count(F.col(one).bitwiseXOR(F.col(two))) <= max_bits


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for distinct fingerprints: root names the component they are in.

    Buckets of one fingerprint end at a window over the keys.
    In the others every member is compared with the bucket's smallest one, which
    joins groups of near copies without all their pairs. What then still lies in
    different components is compared pair by pair, for whole buckets, so that no
    link between components is missed.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find pairs of at most {MAX_BITS} differing bits")
    folder = shared_folder(prints.sparkSession)
    # Most buckets have one fingerprint: a window moves the keys once, where an aggregate joined back does so twice.
    bucket = Window.partitionBy("key")
    keys = _bucketed(prints).withColumns({"low": F.min("fp").over(bucket), "high": F.max("fp").over(bucket)})
    members = written(keys.where(F.col("low") != F.col("high")).drop("high"), f"{folder}/members")
    stars = members.where((F.col("fp") != F.col("low")) & _near("fp", "low", max_bits))
    first = connected_components(stars.select("fp", "low").distinct(), "fp", "low")
    placed = written(
        members.join(first, members.fp == first.node, "left").select(
            "key", "fp", F.coalesce("root", "fp").alias("part")
        ),
        f"{folder}/placed",
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("key")
    )
    open_rows = written(placed.join(mixed, "key", "left_semi"), f"{folder}/open")
    other = open_rows.select("key", F.col("fp").alias("fp2"), F.col("part").alias("part2"))
    on = (open_rows.key == other.key) & (F.col("part") < F.col("part2")) & _near("fp", "fp2", max_bits)
    second = connected_components(open_rows.join(other, on).select("part", "part2").distinct(), "part", "part2")
    for name in ("members", "placed", "open"):
        remove(prints.sparkSession, f"{folder}/{name}")
    parts = prints.join(first, prints.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("part"))
    return parts.join(second, parts.part == second.node, "left").select("fp", F.coalesce("root", "part").alias("root"))


def simhash_components(
    docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable by links.

    Equal fingerprints are one node, represented by their smallest id, whatever
    their number. Null and empty texts have fingerprint 0 and link like any
    other; a null id takes its component's smallest id, and null if there is
    none; repeated rows stay; an empty table gives no rows. Other columns are
    not read.
    """
    folder = shared_folder(docs.sparkSession)
    rows = written(fingerprints(docs, shingle, id_col, text_col), f"{folder}/fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), f"{folder}/classes")
    roots = written(link_fingerprints(classes.select("fp"), max_bits), f"{folder}/roots")
    rooted = classes.join(roots, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def simhash_dedup(
    docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without all but the one of smallest id of each component.

    Rows that repeat an id count as one document, of which one row stays. Rows
    without an id stay, since no component can name them.
    """
    found = simhash_components(docs, shingle, max_bits, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return named.union(docs.where(F.col(id_col).isNull()))
