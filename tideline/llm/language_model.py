"""Operator 8: document log-likelihood by a gated recurrent language model.

Tokens are lower-cased words and an end of text. Every training token is counted; the counts
fix the vocabulary, the output classes, the bias weights and the likelihood of rare words. The
WORDS most frequent ones have outputs of their own, in classes of neighbouring frequency; all
others belong to one of TAIL_CLASSES classes by their first two bytes, and a tail word's share
of its class is its smoothed count. So every word, unseen ones included, has a probability and
the classes' sums are 1.

The network is trained on every training document, once. Rows are dealt to shards by a hash and train
side by side by truncated backpropagation, each of ROUNDS rounds on its share of the documents; after a round
the shards' weights are averaged in a tree, FAN_IN at a time. A shard is a partition sorted by shard
that streams through its task in segments, whatever its size. Scoring carries the state
through each whole document.

A word is known by its 64-bit hash. Counts of the most frequent HELD words are sent to the tasks, a
bounded table; those of other words are joined.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import recurrent
from tideline.llm.recurrent import Shape, Weights
from tideline.llm.texts import fold
from tideline.plans.storage import Scratch

WORDS = 2_048
CLASSES = 32
TAIL_CLASSES = 64
HELD = 131_072
SHARD_TOKENS = 4_000_000
#: Tokens that a shard learns from at a time.
SEGMENT_TOKENS = 1 << 19
ROUNDS = 4
FAN_IN = 64
FOLDS, HELD_OUT = 5, 1
BLOCK = 4_096
CODES_HELD = 1_000_000
LOG10 = float(np.log(10.0))


def hashed(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >> 63 else value


class Known(dict):
    """A table of words that is filled as words are asked for, by ``add``."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.add(word)
        return found


#: Tail class of each start of two bytes, of which there are few.
START_CLASSES = Known(lambda start: hashed(start) % TAIL_CLASSES)


def tail_class(word: bytes) -> int:
    return START_CLASSES[word[:2]]


def tail_classes(words: Iterable[bytes]) -> np.ndarray:
    """``tail_class`` of each word."""
    return np.array([START_CLASSES[word[:2]] for word in words], dtype=np.int32)


END = b""


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


@dataclass(frozen=True)
class LanguageModel:
    """``counts``: hash to count of the held words; ``outputs``: hash to number of those with
    an output; ``tail_tokens`` and ``tail_words``: training tokens and distinct words per class."""

    shape: Shape
    weights: Weights
    outputs: dict[int, int]
    counts: dict[int, int]
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    distinct: int


def numbers_of(outputs: dict[int, int]) -> Known:
    """Input number of each word: that of its output, or that of its tail class."""

    def add(word: bytes) -> int:
        number = outputs.get(hashed(word))
        return len(outputs) + tail_class(word) if number is None else number

    return Known(add)


def coded(words: list[bytes], numbers: dict[bytes, int], kind: type) -> np.ndarray:
    """The numbers of words one after the other."""
    return np.fromiter(map(numbers.__getitem__, words), kind, len(words))


def hashes(words: Iterable[bytes]) -> np.ndarray:
    """``hashed`` of each word."""
    return np.array([xxhash.xxh64_intdigest(word, 42) for word in words], dtype=np.uint64).view(np.int64)


def input_numbers(words: list[bytes], keys: np.ndarray, outputs: dict[int, int]) -> np.ndarray:
    """Input number of each word, ``keys`` being its hash: that of its output, or that of its tail class."""
    found = np.array([outputs.get(key, -1) for key in keys.tolist()], dtype=np.int32)
    rest = np.flatnonzero(found < 0)
    found[rest] = len(outputs) + tail_classes([words[i] for i in rest.tolist()])
    return found


class Coder:
    """Numbers of words for one task: what each adds to a document's sums."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.log_tail = np.log10(np.maximum(model.tail_tokens + 0.5 * (model.tail_words + 1), 0.5))
        self._clear()

    def _clear(self) -> None:
        # Words get the next code when they are first asked for, so the keys are in the order of the codes.
        self.code: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.input, self.hash, self.known = array("i"), array("q"), array("b")
        self.base, self.own = array("d"), array("d")

    def learn(self) -> None:
        """What the words add that were asked for since the last call, all at once."""
        model, words = self.model, list(islice(self.code, len(self.input), None))
        keys = hashes(words)
        counts = np.array([model.counts.get(key, -1) for key in keys.tolist()], dtype=np.float64)
        known = counts >= 0
        seen = np.where(known, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
        inputs = input_numbers(words, keys, model.outputs)
        rest = np.flatnonzero(inputs >= model.shape.words)
        inside = np.zeros(len(words))
        inside[rest] = seen[rest] - self.log_tail[inputs[rest] - model.shape.words]
        self.input.frombytes(inputs.tobytes())
        self.hash.frombytes(keys.tobytes())
        self.known.frombytes(known.astype(np.int8).tobytes())
        self.base.frombytes(seen.tobytes())
        self.own.frombytes(inside.tobytes())

    def codes(self, text: bytes | None) -> np.ndarray:
        return coded(words_of(text), self.code, np.int32)

    def trim(self) -> None:
        """To be called between batches: codes given before are void after it."""
        if len(self.input) > CODES_HELD:
            self._clear()


def token_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(hash, tail, count) of every token of the texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(
                {
                    "hash": hashes(found),
                    "tail": tail_classes(found),
                    "count": np.fromiter(found.values(), np.int64, len(found)),
                }
            )
            found.clear()
            return frame

        for batch in batches:
            for text in batch[text_col]:
                found.update(words_of(text))
                if len(found) > CODES_HELD:
                    yield flush()
        yield flush()

    rows = texts.select(F.col(text_col).cast("binary").alias(text_col)).mapInPandas(counted, "hash long, tail int, count long")
    return rows.groupBy("hash").agg(F.min("tail").alias("tail"), F.sum("count").alias("count"))


def _at_least(counts: DataFrame, most: int) -> int:
    """The smallest count that no more than ``most`` words reach."""
    sizes = counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.col("count").desc()).limit(most).collect()
    total, least = 0, 1 << 62
    for row in sizes:
        total += row["words"]
        if total > most:
            break
        least = row["count"]
    return least


def fit_language_model(docs: DataFrame, learns: Column, text_col: str = "text") -> tuple[LanguageModel, DataFrame]:
    """(the model, the counts of all training words as (hash, count)).

    ``learns`` says which rows are training rows; null texts are empty documents, and
    rows that repeat a document are learned from again.
    """
    scratch = Scratch(docs.sparkSession)
    training = docs.where(learns).select(text_col)
    counts = scratch.write(token_counts(training, text_col), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    held = counts.where(F.col("count") >= _at_least(counts, HELD)).select("hash", "count").collect()
    ranked = sorted(((r["count"], r["hash"]) for r in held), key=lambda pair: (-pair[0], pair[1]))
    end = hashed(END)
    names = [key for _, key in ranked if key != end][: WORDS - 1]
    known = {key: count for count, key in ranked}
    ends = counts.where(F.col("hash") == end).select("count").collect()
    if ends:
        known[end] = ends[0]["count"]
    names = sorted([*names, end], key=lambda key: (-known.get(key, 0), key))
    outputs = {key: number for number, key in enumerate(names)}
    tails = counts.groupBy("tail").agg(F.sum("count").alias("tokens"), F.count("*").alias("words")).collect()
    tail_tokens, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in tails:
        tail_tokens[row["tail"]], tail_words[row["tail"]] = row["tokens"], row["words"]
    chosen = counts.sparkSession.createDataFrame([(key,) for key in names], "hash long")
    for row in counts.join(F.broadcast(chosen), "hash").groupBy("tail").agg(
        F.sum("count").alias("tokens"), F.count("*").alias("words")
    ).collect():
        tail_tokens[row["tail"]] -= row["tokens"]
        tail_words[row["tail"]] -= row["words"]
    own = np.array([known.get(key, 0) for key in names], dtype=np.float64)
    mass = np.cumsum(np.sqrt(own + 1.0))
    starts = np.unique(np.searchsorted(mass, np.arange(CLASSES) * mass[-1] / CLASSES))
    shape = Shape(len(names), tuple(int(s) for s in starts), TAIL_CLASSES)
    weights = recurrent.initial(shape, np.concatenate([own, tail_tokens]))
    model = LanguageModel(shape, weights, outputs, known, tail_tokens, tail_words, tokens, distinct)
    if tokens:
        model = _trained(model, training, text_col, scratch)
    return model, counts.select("hash", "count")


def _coded(training: DataFrame, outputs: dict[int, int], shards: int, text_col: str) -> DataFrame:
    """(shard, round, place, tokens) of every training row; tokens are input numbers of 16 bits.

    The place of a row among the others counts in its hash, so that rows which repeat an id and
    a text go to different shards.
    """

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers = np.zeros(0, dtype=np.uint16)
        for batch in batches:
            if len(held) > CODES_HELD:
                held, numbers = defaultdict(count().__next__), numbers[:0]
            codes = [coded(words_of(text), held, np.int32) for text in batch["text"]]
            # The words that are new in the batch get their numbers at once.
            new = list(islice(held, len(numbers), None))
            numbers = np.concatenate([numbers, input_numbers(new, hashes(new), outputs).astype(np.uint16)])
            yield pd.DataFrame({"place": batch["place"], "tokens": [numbers[part].tobytes() for part in codes]})

    rows = training.select(F.xxhash64(F.monotonically_increasing_id(), text_col).alias("place"), F.col(text_col).cast("binary").alias("text"))
    numbered = rows.mapInPandas(code, "place long, tokens binary")
    return numbered.select(
        F.pmod(F.xxhash64(F.lit("shard"), "place"), F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("round"), "place"), F.lit(ROUNDS)).cast("int").alias("round"),
        "place",
        "tokens",
    )


def _trained(model: LanguageModel, training: DataFrame, text_col: str, scratch: Scratch) -> LanguageModel:
    shards = max(1, round(model.tokens / SHARD_TOKENS))
    numbered = scratch.write(_coded(training, model.outputs, shards, text_col), "coded")
    names = sorted(model.weights)
    sizes = [model.weights[name].size for name in names]
    weights = model.weights
    for turn in range(ROUNDS):
        dealt = numbered.where(F.col("round") == turn).repartitionById(shards, "shard")
        rows = dealt.sortWithinPartitions("shard", "place").select("shard", "tokens").mapInPandas(
            _shard_trainer(model, weights, names), "block int, part int, tokens long, weights array<float>"
        )
        parts = shards
        while parts > 1:
            rows = _averaged(rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")))
            parts = -(-parts // FAN_IN)
        blocks = rows.select("block", "weights").orderBy("block").collect()
        if blocks:
            flat = np.concatenate([np.array(row["weights"], dtype=np.float32) for row in blocks])
            cuts = np.split(flat, np.cumsum(sizes)[:-1])
            weights = {n: cut.reshape(weights[n].shape) for n, cut in zip(names, cuts, strict=True)}
    scratch.drop("coded")
    return LanguageModel(
        model.shape, weights, model.outputs, model.counts, model.tail_tokens, model.tail_words, model.tokens,
        model.distinct,
    )


def _shard_trainer(model: LanguageModel, weights: Weights, names: list[str]):
    end, shape = model.outputs[hashed(END)], model.shape

    def learned(shard: int, trainer: recurrent.Trainer) -> pd.DataFrame:
        last = trainer.finish()
        flat = np.concatenate([last[name].ravel() for name in names])
        blocks = [flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)]
        return pd.DataFrame({"block": range(len(blocks)), "part": shard, "tokens": trainer.tokens, "weights": blocks})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, trainer, held, size = None, None, [], 0
        for batch in batches:
            for number, tokens in zip(batch["shard"], batch["tokens"], strict=True):
                if number != shard:
                    if trainer is not None:
                        trainer.segment(np.concatenate(held))
                        yield learned(shard, trainer)
                    shard, trainer, held, size = number, recurrent.Trainer(weights, shape, end), [], 0
                held.append(np.frombuffer(tokens, dtype=np.uint16).astype(np.int64))
                size += len(held[-1])
                if size >= SEGMENT_TOKENS:
                    trainer.segment(np.concatenate(held))
                    held, size = [np.zeros(0, dtype=np.int64)], 0
        if trainer is not None:
            trainer.segment(np.concatenate(held))
            yield learned(shard, trainer)

    return train


def _averaged(rows: DataFrame) -> DataFrame:
    """The mean, by tokens, of the weights of each block and part; a part has at most FAN_IN rows."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = frame["tokens"].to_numpy(dtype=np.float64)
        average = (tokens @ np.stack(frame["weights"].to_numpy()) / tokens.sum()).astype(np.float32)
        first = {key: [frame[key].iloc[0]] for key in ("block", "part")}
        return pd.DataFrame(first | {"tokens": [int(tokens.sum())], "weights": [average]})

    return rows.groupBy("block", "part").applyInPandas(mean, "block int, part int, tokens long, weights array<float>")


def score_documents(
    docs: DataFrame, model: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row, logarithms to base 10.

    Null and empty texts are the end token alone; null ids and repeated rows are
    scored like others; very long texts are scored whole; an empty table gives no rows;
    other columns are not read. Without training tokens the base score of a token is
    log10(0.5 / 0.5) = 0.
    """
    end = model.outputs[hashed(END)]
    level = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(model)
        for batch in batches:
            coder.trim()
            codes = [coder.codes(text) for text in batch[text_col]]
            if not codes:
                continue
            coder.learn()
            inputs, base = np.array(coder.input), np.array(coder.base)
            own, known, keys = np.array(coder.own), np.array(coder.known, dtype=bool), np.array(coder.hash)
            # Every text has at least its end, so sums over pieces of the batch are sums over texts.
            lengths = np.array([len(c) for c in codes])
            starts, flat = np.cumsum(lengths) - lengths, np.concatenate(codes)
            model_score = recurrent.score(model.weights, model.shape, np.split(inputs[flat], starts[1:]), end) / LOG10
            rare = ~known[flat]
            many = np.add.reduceat(rare, starts, dtype=np.int64)
            yield pd.DataFrame(
                {
                    "row": batch["row"].to_numpy(),
                    id_col: batch[id_col].to_numpy(),
                    "n_tokens": lengths,
                    "n_known": lengths - many,
                    "base": np.add.reduceat(base[flat], starts),
                    "own": np.add.reduceat(own[flat], starts) + model_score,
                    "rare": np.split(keys[flat[rare]], np.cumsum(many)[:-1]),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, `{id_col}` {kind}, n_tokens long, n_known long, base double, own double, rare array<long>"
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), id_col, F.col(text_col).cast("binary").alias(text_col)
    ).mapInPandas(score, schema)
    rows = Scratch(docs.sparkSession).write(rows, "scores")
    pairs = rows.select("row", F.explode("rare").alias("hash"))
    joined = pairs.join(counts, "hash", "left")
    rare = joined.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.5))).alias("rare_score"),
        F.count("count").alias("rare_known"),
    )
    all_rows = rows.drop("rare").join(rare, "row", "left")
    more = F.coalesce("rare_score", F.lit(0.0))
    return all_rows.select(
        id_col,
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(level)).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """True for the rows that are not learned from; a null id is never learned from."""
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True))
