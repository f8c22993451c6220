"""Operator 13: spelling variants, by a bit-sliced position index.

Words are counted in the documents. Two words are near if one inserted, deleted or replaced
code point turns one into the other. For a slice of the vocabulary the index has, for every
(position, letter), a bitset of the words with that letter there. A query walks its own
letters once: the zero-error set keeps the words equal so far, and the one-error sets keep
those that differ by one replaced letter (same position), one letter more (next position) or
one letter less (position before). Each step is a few operations on whole bitsets.

Slices: a word of length s and one of length s or s + 1 that are near agree in their first
s // 2 letters or in their last s // 2, since one error can't be in both. So words meet in
slices by length and hashed half. A half that many words share is cut into slices again,
each of which meets each of the others. A pair counts where its first halves are equal, or
else where its last halves are, so it counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.storage import Scratch

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: The run's h is divisible by this where a letter is taken out.
TYPO_EVERY = 97
#: A form is at least this many times as frequent as its variant.
FORM_RATIO = 2
#: Words that a slice should have, and the most that one task indexes.
SLICE_WORDS = 1_024
MOST_WORDS = 4_096
#: Words of this length or more are dealt to slices together; within a slice lengths are apart.
LONG_WORD = 64
#: Words that a task counts before it passes them on.
FLUSH_WORDS = 300_000


def word_counts(
    docs: DataFrame,
    typo_every: int | None = TYPO_EVERY,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): the words of whole texts, A-Z lower-cased, and how often they occur.

    With ``typo_every`` a run whose crc32 of ``<id>:<run>`` it divides loses the letter at
    that crc32 modulo the length; None leaves runs as they are. Counts are added up in the
    tasks before the shuffle, so a word with a third of all occurrences is a few rows.
    """
    runs = re.compile("[a-z\u00c0-\u00ff]+")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                start = crc32(f"{doc_id or ''}:".encode())
                found = Counter(runs.findall(text.lower().decode("utf-8", "replace")))
                for run, times in found.items():
                    if typo_every:
                        h = crc32(run.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= least_letters:
                        tally[run] += times
                if len(tally) > FLUSH_WORDS:
                    yield pd.DataFrame({"word": list(tally), "n": list(tally.values())})
                    tally = Counter()
        yield pd.DataFrame({"word": pd.Series(list(tally), dtype=object), "n": pd.Series(list(tally.values()), dtype="int64")})

    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    parts = texts.mapInPandas(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets of words by (position, letter), for words of length ``least`` and ``least`` + 1."""

    def __init__(self, words: list[str], least: int):
        self.least = least
        codes = _letters(words, least + 1)
        self.letters = np.unique(codes)
        places = np.searchsorted(self.letters, codes)
        self.size, self.width = len(words), -(-len(words) // 64)
        self.bits = np.zeros((least + 1, len(self.letters) + 1, self.width), dtype=np.uint64)
        for at in range(least + 1):
            marks = np.zeros((len(self.letters) + 1, self.width * 64), dtype=np.uint8)
            marks[places[:, at], np.arange(self.size)] = 1
            self.bits[at] = np.packbits(marks, axis=1, bitorder="little").view(np.uint64)
        if self.letters[0] == 0:  # the shorter words have no letter at the last position
            self.shorter = self.bits[least, 0].copy()
            self.bits[:, 0] = 0
        else:
            self.shorter = np.zeros(self.width, dtype=np.uint64)
        every = np.zeros(self.width * 64, dtype=np.uint8)
        every[: self.size] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    def _places(self, queries: list[str], length: int) -> np.ndarray:
        codes = _letters(queries, length)
        places = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[places] == codes, places, len(self.letters))

    def near(self, queries: list[str], length: int) -> np.ndarray:
        """A row of bits per query (all of one length): the words one error away.

        Queries of the index's shorter length find words of both lengths; queries of the
        longer length find the shorter words.
        """
        asked = self._places(queries, length)
        equal = np.tile(self.every, (len(queries), 1))
        if length == self.least:
            replaced, longer = np.zeros_like(equal), np.zeros_like(equal)
            for at in range(length):
                here = self.bits[at][asked[:, at]]
                longer = (longer | equal) & self.bits[at + 1][asked[:, at]]
                replaced = (replaced & here) | (equal & ~here)
                equal = equal & here
            found = (replaced & self.shorter) | ((longer | equal) & self.every & ~self.shorter)
        else:
            shorter = np.zeros_like(equal)
            for at in range(length):
                if at:
                    shorter &= self.bits[at - 1][asked[:, at]]
                shorter |= equal
                equal = equal & self.bits[at][asked[:, at]]
            found = shorter & self.shorter
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.size]


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


def _near_in_slice(part: pd.DataFrame) -> Iterator[tuple]:
    """(word, near, best_n, best_word) of the queries of one slice and least length."""
    least, by_last = int(part["least"].iloc[0]), bool(part["by_last"].iloc[0])
    indexed = part[part["indexed"]].drop_duplicates("word")
    asked = part[part["asked"]].drop_duplicates("word")
    if not len(indexed) or not len(asked):
        return
    words, counts = indexed["word"].to_numpy(), indexed["n"].to_numpy()
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    index = PositionIndex(list(words), least)
    half = least // 2
    for length, group in asked.groupby(asked["word"].str.len()):
        queries = group["word"].to_numpy()
        rows, found = np.nonzero(index.near(list(queries), int(length)))
        halves = np.unique([w[:half] for w in [*queries, *words]], return_inverse=True)[1]
        same = halves[rows] == halves[len(queries) + found]
        if by_last:
            halves = np.unique([w[-half:] for w in [*queries, *words]], return_inverse=True)[1]
            same = ~same & (halves[rows] == halves[len(queries) + found])
        rows, found = rows[same], found[same]
        ranked = np.lexsort((found, -counts[found], rows))
        rows, found = rows[ranked], found[ranked]
        firsts = np.flatnonzero(np.diff(rows, prepend=-1))
        near = np.diff(np.append(firsts, len(rows)))
        for at, many in zip(firsts, near, strict=True):
            yield queries[rows[at]], int(many), int(counts[found[at]]), words[found[at]]


def _near_words(cell: pd.DataFrame) -> pd.DataFrame:
    rows = [row for _, part in cell.groupby("least") for row in _near_in_slice(part)]
    return pd.DataFrame(rows, columns=["word", "near", "best_n", "best_word"])


def _slices(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (word, n, least, by_last, class, slice, i, j, indexed, asked), a task's cell being (class .. j)."""
    sized = vocabulary.withColumn("length", F.char_length("word"))
    short = F.least("length", F.lit(LONG_WORD))
    # At most LONG_WORD rows reach the driver.
    many = {r["k"]: r["many"] for r in sized.groupBy(short.alias("k")).agg(F.count("*").alias("many")).collect()}
    slices = [max(1, -(-(many.get(k, 0) + many.get(k + 1, 0)) // SLICE_WORDS)) for k in range(LONG_WORD + 1)]
    leasts = F.explode(F.array("length", F.col("length") - 1)).alias("least")
    halves = F.explode(F.array(F.lit(False), F.lit(True))).alias("by_last")
    met = sized.select("word", "n", leasts).where(F.col("least") >= 1).select("*", halves)
    half = F.floor(F.col("least") / 2).cast("int")
    text = F.when(F.col("by_last"), F.expr("right(word, cast(floor(least / 2) AS int))")).otherwise(F.substring("word", F.lit(1), half))
    kind: Column = F.least("least", F.lit(LONG_WORD))
    met = met.withColumn("class", kind).withColumn(
        "slice", F.pmod(F.xxhash64(text), F.get(F.array(*map(F.lit, slices)), kind)).cast("long")
    )
    met = scratch.write(met, "met")
    keys = ["class", "by_last", "slice"]
    sizes = met.groupBy(*keys).agg(F.ceil(F.count("*") / MOST_WORDS).cast("int").alias("chunks"))
    # Only slices of a crowded half have more than one chunk.
    placed = met.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("word", F.lit(7)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    placed = placed.select("*", other)
    one = F.col("own") == F.col("other")
    roles = F.when(one, F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("asked"))))
    roles = roles.otherwise(
        F.array(
            F.struct(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("asked")),
            F.struct(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")),
        )
    )
    return placed.select("word", "n", "least", *keys, F.inline(roles))


def spelling_variants(
    docs: DataFrame,
    typo_every: int | None = TYPO_EVERY,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for every word of the vocabulary.

    ``form`` is the near word of largest count, ties by code points, if it has at least
    ``ratio`` times the word's count; else it is null, as is ``form_n``. ``root`` follows forms
    to the last. Null and empty texts have no words; a null id counts as an empty text in
    the hash; rows that repeat a document count again; texts of any length are read whole, as are
    words. An empty table has no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.write(word_counts(docs, typo_every, least_letters, least_count, id_col, text_col), "vocabulary")
    cells = _slices(vocabulary, scratch)
    found = cells.groupBy("class", "by_last", "slice", "i", "j").applyInPandas(
        _near_words, "word string, near long, best_n long, best_word string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best_word").alias("w")))
    near = scratch.write(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")), "near")
    scratch.drop("met")
    frequent = -F.col("best.minus") >= ratio * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word",
        F.when(frequent, F.col("best.w")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.minus")).cast("long").alias("form_n"),
    )
    words = scratch.write(words, "words")
    scratch.drop("vocabulary", "near")
    roots = _roots(words, scratch)
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form, by doubling: counts double along forms, so few turns do."""
    name = "roots-0"
    roots = scratch.write(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), name)
    turn = 0
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        turn, before = turn + 1, name
        name = f"roots-{turn}"
        written = scratch.write(moved, name)
        scratch.drop(before)
        roots = written.select("word", "root")
        if written.where("moved").isEmpty():
            return roots
