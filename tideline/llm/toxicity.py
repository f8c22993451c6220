"""Operator 6: toxic passages by maximum-scoring segments.

A word's evidence is the largest log-odds among the character n-grams of its marked
form ``^word$``; n-grams also catch inflected and compounded forms. Log-odds compare
the share of toxic and of other documents that hold an n-gram, each smoothed by a
Dirichlet prior in proportion to its share of all documents, and count only if they
exceed Z_LEAST standard errors; all else is 0. The k-th time that a word comes in a
text its evidence counts one k-th, since repeats are not independent. Every word pays DRIFT, so scores fall
in ordinary text and rise in toxic passages. A linear scan finds every maximal
segment (Ruzzo and Tompa 1999). The largest score of an ordinary text of ``n`` words
follows an extreme-value law with parameters lambda and K (Karlin and Altschul 1990),
estimated from the documents without the label; a logistic curve takes that standardised
score to a probability.

Parameters of the law and of the curve come from scans of the learning documents with
n-grams learned without the scanned document's own fold, so that a document is no
evidence for itself. Texts that occur more than once are learned from once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.texts import fold
from tideline.plans.storage import remove, shared_folder, written

GRAM = 5
PRIOR_DOCS = 50.0
Z_LEAST = 2.5
DRIFT = 1.0
#: Labelled documents that are learned from, at most, up to the chance of a hash: the smallest
#: hashes of ids. It bounds the lexicon that tasks hold; all else covers every document.
LABELLED_ROWS = 2_000_000
#: A passage is reported if fewer than this many as good are expected in an ordinary text.
E_MOST = 0.05
FOLDS = 4
HELD_OUT = 2
BIN = 0.25
TRIM = ".,;:!?\"'()"


@dataclass(frozen=True)
class ToxicityModel:
    """``grams``: n-gram to log-odds; the extreme-value law; the logistic curve."""

    grams: dict[str, float]
    lam: float
    log_k: float
    slope: float
    offset: float

    def standardised(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self.lam * best - self.log_k - np.log(np.maximum(words, 1))

    def probability(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = np.clip(self.offset + self.slope * self.standardised(best, words), -40, 40)
        return 1.0 / (1.0 + np.exp(-z))


def word_grams(word: str) -> list[str]:
    marked = f"^{word.strip(TRIM)}$"
    return [marked[at : at + GRAM] for at in range(max(1, len(marked) - GRAM + 1))]


class Scanner:
    """Word scores of texts; remembers the scores of words it has seen."""

    def __init__(self, grams: dict[str, float]):
        self.grams = grams
        self.held: dict[str, float] = {}

    def scores(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        held, grams = self.held, self.grams
        if len(held) > 1_000_000:
            held.clear()
        try:
            found = np.array([held[w] for w in words])
        except KeyError:
            for w in words:
                if w not in held:
                    held[w] = max(grams.get(g, 0.0) for g in word_grams(w))
            found = np.array([held[w] for w in words])
        times: Counter = Counter()
        for at in np.nonzero(found)[0].tolist():
            times[words[at]] += 1
            found[at] /= times[words[at]]
        return found - DRIFT


def best_segment(scores: np.ndarray) -> float:
    """The largest sum of a run of scores, 0 if none is positive."""
    if not len(scores):
        return 0.0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return float(np.max(sums - np.minimum.accumulate(sums)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) in linear time, in order."""
    kept: list[list[float]] = []  # first, end, sum before it, sum up to its end
    total = 0.0
    for at, score in enumerate(scores.tolist()):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at + 1, before, total]
        while True:
            back = len(kept) - 1
            while back >= 0 and kept[back][2] >= new[2]:
                back -= 1
            if back < 0 or kept[back][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[back][0], new[1], kept[back][2], new[3]]
            del kept[back:]
    return [(int(a), int(b), high - low) for a, b, low, high in kept]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    labelled_rows: int = LABELLED_ROWS,
) -> ToxicityModel:
    """Learns from the labelled documents that are not held out (crc32 of the id modulo 4 is 2), all
    of them up to about ``labelled_rows``.

    Null labels, ids and texts teach nothing; the label of repeated ids and texts is
    1 if any of them has it. Without documents of both labels nothing is toxic.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.where(fold(F.col(id_col), FOLDS) != HELD_OUT)
    many = known.count()
    if many > labelled_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("learn"), id_col), F.lit(many)) < labelled_rows)
    # The fold left out is known from the id, so its documents need not be shuffled.
    docs = docs.where(fold(F.col(id_col), FOLDS) != HELD_OUT)
    hashes = docs.where(F.col(text_col).isNotNull()).select(id_col, F.xxhash64(text_col).alias("hash"))
    once = hashes.join(known, id_col).groupBy("hash").agg(F.min(id_col).alias(id_col), F.max("toxic").alias("toxic"))
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(once.select(id_col, "toxic"), id_col)
    learn = texts.dropDuplicates([id_col]).select("text", "toxic", fold(F.col(id_col), FOLDS).alias("fold"))
    learn = written(learn.where(F.col("text").isNotNull()), f"{folder}/learn")
    totals = {(r["fold"], r["toxic"]): r["count"] for r in learn.groupBy("fold", "toxic").count().collect()}
    if not all(any(t == toxic for _, t in totals) for toxic in (0, 1)):
        return ToxicityModel({}, 1.0, 0.0, 0.0, -40.0)
    counts = written(_gram_counts(learn), f"{folder}/grams")
    lexicons = {out: _lexicon(counts, totals, out) for out in [None, *sorted({f for f, _ in totals})]}
    scans = written(_learning_scans(learn, lexicons), f"{folder}/scans")
    lam, log_k = _extreme_value_law(scans)
    model = ToxicityModel(lexicons[None], lam, log_k, 0.0, 0.0)
    slope, offset = _logistic(scans, model)
    for name in ("learn", "grams", "scans"):
        remove(docs.sparkSession, f"{folder}/{name}")
    return ToxicityModel(lexicons[None], lam, log_k, slope, offset)


def _gram_counts(learn: DataFrame) -> DataFrame:
    """(gram, fold, toxic, docs): the learning documents that hold each n-gram."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(*key, n) for key, n in found.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["gram", "fold", "toxic", "docs"])

        for batch in batches:
            for text, part, toxic in zip(batch["text"], batch["fold"], batch["toxic"], strict=True):
                grams = {gram for word in set(text.lower().split()) for gram in word_grams(word)}
                found.update((gram, part, toxic) for gram in grams)
                if len(found) > 500_000:
                    yield flush()
        yield flush()

    rows = learn.mapInPandas(count, "gram string, fold int, toxic int, docs long")
    return rows.groupBy("gram", "fold", "toxic").agg(F.sum("docs").alias("docs"))


def _lexicon(counts: DataFrame, totals: dict, out: int | None) -> dict[str, float]:
    """N-grams of significant positive log-odds, learned without the fold ``out``."""
    toxic_docs = sum(n for (f, t), n in totals.items() if t == 1 and f != out)
    other_docs = sum(n for (f, t), n in totals.items() if t == 0 and f != out)
    if not toxic_docs or not other_docs:
        return {}
    kept = counts if out is None else counts.where(F.col("fold") != out)
    sums = kept.groupBy("gram").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("a"), F.sum("docs").alias("all")
    )
    prior = F.col("all") / (toxic_docs + other_docs) * PRIOR_DOCS
    a, b = F.col("a") + prior, F.col("all") - F.col("a") + prior

    def odds(value, docs: int):
        return F.log(value / (docs + PRIOR_DOCS - value + 0.5))

    scored = sums.where("a > 0").select(
        "gram",
        (odds(a, toxic_docs) - odds(b, other_docs)).alias("odds"),
        F.sqrt(1 / a + 1 / b).alias("error"),
    )
    best = scored.where(F.col("odds") >= Z_LEAST * F.col("error"))
    return {r["gram"]: r["odds"] for r in best.collect()}


def _learning_scans(learn: DataFrame, lexicons: dict) -> DataFrame:
    """(toxic, words, best, bins): each learning document scanned without its own fold's n-grams."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners: dict[int, Scanner] = {}
        for batch in batches:
            rows = []
            for text, part, toxic in zip(batch["text"], batch["fold"], batch["toxic"], strict=True):
                scores = scanners.setdefault(part, Scanner(lexicons[part])).scores(text)
                bins, numbers = np.unique(np.rint(scores / BIN).astype(np.int64), return_counts=True)
                rows.append((toxic, len(scores), best_segment(scores), bins.tolist(), numbers.tolist()))
            yield pd.DataFrame(rows, columns=["toxic", "words", "best", "bins", "numbers"])

    return learn.mapInPandas(scan, "toxic int, words long, best double, bins array<long>, numbers array<long>")


def _extreme_value_law(scans: DataFrame) -> tuple[float, float]:
    """(lambda, log K) of the largest segment score of texts without the label."""
    clean = scans.where("toxic = 0 AND words > 0")
    pairs = clean.select(F.explode(F.arrays_zip("bins", "numbers")).alias("p"))
    rows = pairs.groupBy(F.col("p.bins").alias("bin")).agg(F.sum("p.numbers").alias("n")).collect()
    if not rows:
        return 1.0, 0.0
    values = np.array([r["bin"] * BIN for r in rows])
    shares = np.array([float(r["n"]) for r in rows])
    shares /= shares.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        if np.log(shares @ np.exp(middle * values)) > 0:
            high = middle
        else:
            low = middle
    lam = low
    mean = clean.agg(F.avg(F.col("best") * lam - F.log("words"))).first()[0]
    return lam, float(mean) - 0.5772156649


def _logistic(scans: DataFrame, model: ToxicityModel) -> tuple[float, float]:
    """(slope, offset) of the label on the standardised score, from counts in bins of BIN."""
    x = F.lit(model.lam) * F.col("best") - F.lit(model.log_k) - F.log(F.greatest("words", F.lit(1)))
    bins = scans.groupBy(F.round(x / BIN).alias("bin")).agg(F.sum("toxic").alias("ones"), F.count("*").alias("n"))
    rows = bins.collect()
    x = np.array([r["bin"] * BIN for r in rows])
    ones, n = np.array([float(r["ones"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    weights, ridge = np.array([math.log((ones.sum() + 0.5) / (n.sum() - ones.sum() + 0.5)), 0.0]), 0.01
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        gradient = design.T @ (ones - n * p) - ridge * weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return max(0.0, float(weights[1])), float(weights[0])


def without_toxic(docs: DataFrame, model: ToxicityModel, least: float, text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``least``, with all their columns; null texts count as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(model.grams)
        for batch in batches:
            scores = [scanner.scores(text) for text in batch]
            best = np.array([best_segment(s) for s in scores])
            yield pd.Series(model.probability(best, np.array([len(s) for s in scores])), dtype="float64")

    return docs.where(F.pandas_udf(score, "double")(F.col(text_col)) < least)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score, words, passages) for every row; whole texts are scanned.

    Passages are the segments that an ordinary text of that length would show fewer
    than E_MOST times: (first word, word after the last, score, expected number).
    Null and empty texts have no words, the lowest evidence and no passage; null ids
    and repeated rows are scored like others; an empty table gives no rows; other
    columns are not read.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model.grams)
        for batch in batches:
            best, words, passages = [], [], []
            for text in batch[text_col]:
                scores = scanner.scores(text)
                best.append(best_segment(scores))
                words.append(len(scores))
                expected = model.log_k + math.log(max(1, len(scores)))
                least = (expected - math.log(E_MOST)) / model.lam
                found = maximal_segments(scores) if best[-1] >= least and best[-1] > 0 else []
                passages.append(
                    [(a, b, s, math.exp(expected - model.lam * s)) for a, b, s in found if s >= least]
                )
            yield pd.DataFrame(
                {
                    id_col: batch[id_col],
                    "score": model.probability(np.array(best), np.array(words)),
                    "words": words,
                    "passages": passages,
                }
            )

    columns = docs.select(id_col, text_col)
    kind = columns.schema[id_col].dataType.simpleString()
    passage = "array<struct<first:long,end:long,score:double,expected:double>>"
    return columns.mapInPandas(scan, f"`{id_col}` {kind}, score double, words long, passages {passage}")
