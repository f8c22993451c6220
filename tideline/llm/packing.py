"""Operator 4: best-fit packing of token sequences by large-item matching.

Where a document goes depends on its length alone, so the packing is worked out
on the histogram of lengths, at most ``capacity`` rows whatever the input, and
covers all documents at once:

* lengths above a third of the capacity go at most twice in a bin: from the
  longest down, each is matched with the longest that still fits beside it;
* the others, from the longest down, go where the gap that holds them is
  smallest, a new bin if there is none.

Equal lengths move together, so a step of the plan is a range of ranks within a
length. Documents join the plan by length and rank.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.plans.storage import shared_folder, written

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 2_000
#: Entries of a Python worker's memory of words and their ids, which its tasks share.
WORDS_HELD = 1_000_000
#: Last bytes of letters: ASCII ones, and those of Latin-1, which follow a byte C3.
ASCII_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LATIN_LETTERS = frozenset(range(0x80, 0xC0)) - {0x97, 0xB7}
STOPS = (b",", b".")
#: Lower-case letters of ASCII and Latin-1: no normal form or other rule changes a word of them.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


class HeldWords(dict):
    """Words and their ids, learned when a word is first asked for.

    Once there are WORDS_HELD / 2 of them they become the older ones, of which a word that is asked for
    again comes back, and the older ones before go: so frequent words stay and no more than WORDS_HELD are held.
    """

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids

    def trim(self) -> None:
        if 2 * len(self) > WORDS_HELD:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts from the ids of their words, which are looked up once.

    The tokenizer's pre-tokens never cross white space, so a text's ids are those
    of its white-space separated parts, one after the other. A comma or full stop
    that ends a part after a letter is a pre-token of its own, and the tokenizer
    folds case, so forms with stops and capitals share one look-up. Where the
    tokenizer treats words of letters as its model does, these go there directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.held = HeldWords(self._learned)
        marks = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): marks.pre_tokenize_str(c)[0][0] for c in LETTERS if ord(c) > 127}
        self.letters = re.compile(f"[{LETTERS}{LETTERS.upper().replace('SS', '')}]+").fullmatch
        probe = ["the", "Ümläute", "Ça", "straße", LETTERS]
        self.direct = all(self._model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _model(self, word: str) -> list[int]:
        """Ids of a word of letters from the tokenizer's model alone, without its text stages."""
        word = word.lower()
        return [token.id for token in self.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        self.held.trim()
        look = self.held.__getitem__
        return [b"".join(map(look, (text or "").encode("utf-8").split())) for text in texts]

    def _learned(self, word: bytes) -> bytes:
        core, stop = _core(word)
        if core != word:
            return self.held[core] + self.held[stop] if stop else self.held[core]
        text = word.decode("utf-8")
        if self.direct and self.letters(text):
            ids = self._model(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker: what one task has learned the next ones know."""
    return WordEncoder(path)


def _core(word: bytes) -> tuple[bytes, bytes]:
    """The word without a stop of its own, in lower case if it is all ASCII letters; the stop."""
    stop = b""
    if len(word) > 1 and word[-1:] in STOPS:
        last = word[-2]
        if last in ASCII_LETTERS or len(word) > 2 and word[-3] == 0xC3 and last in LATIN_LETTERS:
            word, stop = word[:-1], word[-1:]
    return (word.lower() if word.isalpha() else word), stop


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents' ids, cut only above the capacity.

    ``ids`` are little-endian unsigned 32-bit numbers; every document ends with ``end_id``.
    """
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                rows = []
                for name, ids in zip(part[id_col], encoder.encode(part[text_col].tolist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((name, piece, start // 4, len(own) // 4, zlib.crc32(own), own))
                frame = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", "ids"])
                frame[id_col] = frame[id_col].astype(part[id_col].dtype)
                yield frame if with_ids else frame.drop(columns="ids")

    columns = docs.select(id_col, text_col)
    kind = columns.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return columns.mapInPandas(pieces, schema + (", ids binary" if with_ids else ""))


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, end rank, first bin, per bin, offset) that pack the histogram."""
    left = {length: count for length, count in histogram.items() if count}
    used: dict[int, int] = defaultdict(int)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    bins = 0

    def place(length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        steps.append((length, used[length], used[length] + count, first_bin, per_bin, offset))
        used[length] += count
        left[length] -= count

    def opened(gap: int, first_bin: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first_bin, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for other in (n for n in large if n <= min(length, capacity - length)):
            pairs = left[length] // 2 if other == length else min(left[length], left[other])
            if pairs:
                place(length, pairs, bins, 1, 0)
                place(other, pairs, bins, 1, length)
                opened(capacity - length - other, bins, pairs)
                bins += pairs
            if not left[length]:
                break
        if left[length]:
            alone = left[length]
            place(length, alone, bins, 1, 0)
            opened(capacity - length, bins, alone)
            bins += alone
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                gap, first_bin, count = capacity, bins, -(-left[length] // (capacity // length))
                bins += count
            else:
                gap = sizes[at]
                first_bin, count = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            per_bin = gap // length
            full = min(count, left[length] // per_bin)
            if full:
                place(length, full * per_bin, first_bin, per_bin, capacity - gap)
                opened(gap - per_bin * length, first_bin, full)
            if full < count:
                some = left[length]
                if some:
                    place(length, some, first_bin + full, some, capacity - gap)
                    opened(gap - some * length, first_bin + full, 1)
                    full += 1
                opened(gap, first_bin + full, count - full)
    return steps


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``pieces`` is read three times, so give a written table.

    Ranks within a length are counted in buckets of about BUCKET_ROWS rows plus
    the rows of earlier buckets, so that no length has to fit one task. The plan
    is broadcast: it has a few steps for each possible length.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    steps = packing_plan(counts, capacity)
    plan = spark.createDataFrame(
        steps, "length long, low long, high long, first_bin long, per_bin long, base long"
    )
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    sums = placed.groupBy("length", "bucket").count()
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "plan_length")),
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    nth = F.col("rank") - F.col("low")
    return found.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
        (F.col("base") + nth % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null and empty texts are the end token alone; null ids and repeated rows are
    packed like others; very long texts give several pieces; an empty table gives
    no rows; other columns are not read. ``tokenizer`` is the path of a tokenizer
    file whose pre-tokens do not cross white space, on every executor.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col)
    return place_pieces(written(pieces, f"{shared_folder(docs.sparkSession)}/pieces"), capacity, id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; a group is at most one capacity."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), part.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"]))
    return grouped.select("sequence_id", "length", whole.alias("ids"))
