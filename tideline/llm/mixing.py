"""Operator 1: mixing sources to target weights, in DataFrame functions alone.

Each source's documents are laid end to end (by a hash bucket of the id, then by
id) and packed into blocks of a fixed number of words. A source owes the mix its
target number of words, so a number of slots; slot ``i`` holds block ``p(i)`` of
a pass, where ``p`` is a pseudorandom permutation of the source's block numbers
that differs for each pass. All slots are dealt to output shards of equal size by
a permutation of all slot numbers: the counts of the sources in a shard are a
multinomial draw conditioned on every source's total, so that targets are met and
no pass is exceeded. Blocks join their slots by (source, block number).

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway 2012): each round
pairs ``x`` with ``(k - x) mod n`` and swaps the pair or not by one hashed bit. They
are exact for any ``n`` and need no sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.texts import word_count
from tideline.plans.storage import remove, shared_folder, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
BUCKET_ROWS = 2_000
CHUNK_SLOTS = 4096
TASK_SLOTS = 65_536
ROUNDS = 16
SEED = 20_240_601


def permuted(frame: DataFrame, name: str, index: Column, size: str, salt: Column, inverse: bool = False) -> DataFrame:
    """The frame with ``name``: where the permutation of 0 .. size-1 named by ``salt`` takes ``index``.

    Each round is a projection of its own, so that its code stays small. A round
    undoes itself, so the inverse runs them backwards.
    """
    n = F.col(size)
    frame = frame.withColumn(name, index.cast("long")).withColumn(f"{name}_salt", salt)
    for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        key = F.pmod(F.xxhash64(F.lit(SEED), F.lit(turn), f"{name}_salt"), n)
        high = F.greatest(F.col(name), F.col(f"{name}_pair"))
        bit = F.xxhash64(F.lit(SEED + 1), F.lit(turn), f"{name}_salt", high).bitwiseAND(F.lit(1).cast("long"))
        frame = frame.withColumn(f"{name}_pair", F.pmod(key - F.col(name), n))
        frame = frame.withColumn(name, F.when(bit == 1, F.col(f"{name}_pair")).otherwise(F.col(name)))
    return frame.drop(f"{name}_salt", f"{name}_pair")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES
) -> DataFrame:
    """One row per source: rank, source, source_size, target.

    ``sizes`` has (source, source_size). Ranks go by code point, null last, and
    weights repeat. Targets share ``share`` of all words by weight, none above
    ``most`` times its source: in order of size by weight, a source is at its
    limit if the level that the others would share exceeds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * share
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("budget", budget).withColumn("full", F.col("most") <= F.col("weight") * left / heavy)
    full_most = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(
        F.col("weight") * (F.col("budget") - full_most) / F.nullif(open_weight, F.lit(0.0))
    )
    return ranked.select("rank", "source", "source_size", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """``rows``: the documents with rank, size, source_size, target and ``first``,
    the number of their first word in their source. ``slots``: (shard, slot, rank,
    pass, block, words). ``pieces``: (rank, first, pass, shard, slot, start, stop),
    the words ``start`` to ``stop`` of the document that begins at ``first``."""

    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> Mix:
    """The mix of all documents; ``carry`` names further columns that ``rows`` keep.

    Null and empty texts have no words, are never taken and stay in ``rows``; the
    null source is a source of its own, and a null id sorts first; rows that repeat
    an id are laid out one after the other; an empty table gives empty frames. The
    columns of ``rows`` that this adds start with ``mix_``, so none clashes with
    what is carried.
    """
    folder = shared_folder(docs.sparkSession)
    mark = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("mix_id"),
        mark.alias("mix_mark"),
        word_count(F.col(text_col)).alias("mix_size"),
        *[F.col(name) for name in carry],
    )
    sized = written(sized, f"{folder}/sized")
    totals = sized.groupBy("mix_mark").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("rows"))
    totals = totals.withColumn("source", F.when(F.col("mix_mark") != "", F.substring("mix_mark", 2, 1 << 30)))
    sources = written(
        source_targets(totals.select("source", "source_size"), weights, share, most).withColumn(
            "mark", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
        ),
        f"{folder}/sources",
    )
    rows = written(_laid_out(sized, sources), f"{folder}/rows")
    remove(docs.sparkSession, f"{folder}/sized")
    slots = written(_slots(sources, block_words, shard_slots, f"{folder}/plan"), f"{folder}/slots")
    return Mix(rows, slots, _pieces(rows, slots, block_words))


def _laid_out(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with rank, targets and the number of the first word.

    Running sums are taken in two steps, within buckets of about BUCKET_ROWS rows
    and over the buckets' sums, so that no source has to fit one task.
    """
    buckets = sized.agg(F.greatest(F.ceil(F.count("*") / BUCKET_ROWS), F.lit(1)).alias("n"))
    n = int(buckets.first()["n"])
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("mix_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    placed = sized.withColumn("mix_bucket", digest.cast("long") % n)
    sums = placed.groupBy("mix_mark", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    earlier = Window.partitionBy("mix_mark").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "mix_mark", "mix_bucket", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)).alias("mix_before")
    )
    about = sources.select(
        F.col("mark").alias("mix_mark"),
        F.col("rank").alias("mix_rank"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    sums = sums.join(about, "mix_mark")
    within = (
        Window.partitionBy("mix_mark", "mix_bucket")
        .orderBy("mix_id", "mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = placed.withColumn("mix_first", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    return (
        running.join(sums, ["mix_mark", "mix_bucket"])
        .withColumn("mix_first", F.col("mix_first") + F.col("mix_before"))
        .drop("mix_before", "mix_bucket", "mix_mark")
    )


def _pass_salt(rank: Column, turn: Column) -> Column:
    return (rank.cast("long") * 1_009 + turn.cast("long") * 7 + 1).cast("long")


def _slots(sources: DataFrame, block_words: int, shard_slots: int, path: str) -> DataFrame:
    """Every slot of the mix with the block it holds and how many of its words."""
    size, owed = F.col("source_size"), F.col("owed")
    plan = (
        sources.where(size > 0)
        .withColumn("owed", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(size / block_words).cast("long"))
        .withColumn("full", F.floor(owed / size).cast("long"))
        .withColumn("rest", owed - F.col("full") * size)
        .withColumn("short", F.col("blocks") * block_words - size)
    )
    salt = _pass_salt(F.col("rank"), F.col("full"))
    plan = permuted(plan, "short_at", F.col("blocks") - 1, "blocks", salt, inverse=True)
    even = F.ceil(F.col("rest") / block_words)
    odd = F.ceil((F.col("rest") + F.col("short")) / block_words)
    before = F.col("more") - 1
    reached = before * block_words - F.when(before > F.col("short_at"), F.col("short")).otherwise(0)
    plan = (
        plan.withColumn("more", F.when(even <= F.col("short_at"), even).otherwise(odd).cast("long"))
        .withColumn("last_words", (F.col("rest") - reached).cast("long"))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.col("more"))
    )
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("from", F.coalesce(F.sum("slots").over(earlier), F.lit(0))).withColumn(
        "all", F.sum("slots").over(Window.partitionBy())
    )
    plan = written(plan, path)
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    chunks = plan.where("slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK_SLOTS)))
    )
    chunks = chunks.repartition(max(1, -(-total // TASK_SLOTS)), "rank", "chunk")
    start = F.col("chunk") * CHUNK_SLOTS
    end = F.least(F.col("slots"), start + CHUNK_SLOTS) - 1
    each = chunks.withColumn("i", F.explode(F.sequence(start, end)))
    turn = F.floor(F.col("i") / F.col("blocks")).cast("long")
    each = each.withColumn("pass", turn).withColumn("at", F.col("i") - F.col("pass") * F.col("blocks"))
    each = permuted(each, "block", F.col("at"), "blocks", _pass_salt(F.col("rank"), F.col("pass")))
    whole = F.when(F.col("block") == F.col("blocks") - 1, block_words - F.col("short")).otherwise(block_words)
    cut = (F.col("pass") == F.col("full")) & (F.col("at") == F.col("more") - 1)
    each = each.withColumn("words", F.when(cut, F.col("last_words")).otherwise(whole).cast("long"))
    each = permuted(each, "place", F.col("from") + F.col("i"), "all", F.lit(0).cast("long"))
    return each.select(
        F.floor(F.col("place") / shard_slots).cast("long").alias("shard"),
        (F.col("place") % shard_slots).alias("slot"),
        "rank",
        "pass",
        "block",
        "words",
    )


def _pieces(rows: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """The words of documents that the slots take: documents' blocks joined by index."""
    first, size = F.col("mix_first"), F.col("mix_size")
    spans = rows.where(size > 0).select(
        F.col("mix_rank").alias("rank"),
        first.alias("first"),
        size.alias("size"),
        F.explode(
            F.sequence(F.floor(first / block_words), F.floor((first + size - 1) / block_words))
        ).alias("block"),
    )
    begin = F.col("block") * block_words
    joined = spans.join(slots, ["rank", "block"])
    start = F.greatest(begin, F.col("first"))
    stop = F.least(begin + F.col("words"), F.col("first") + F.col("size"))
    return joined.where(stop > start).select(
        "rank",
        "first",
        "pass",
        "shard",
        "slot",
        (start - F.col("first")).alias("start"),
        (stop - F.col("first")).alias("stop"),
    )


def taken_words(mix: Mix) -> DataFrame:
    """``rows`` with ``taken``, the words that the mix takes of each, repeats counted."""
    sums = mix.pieces.groupBy("rank", "first").agg(F.sum(F.col("stop") - F.col("start")).alias("mix_taken"))
    sums = sums.select(F.col("rank").alias("mix_rank"), F.col("first").alias("mix_first"), "mix_taken")
    some = mix.rows.where("mix_size > 0").join(sums, ["mix_rank", "mix_first"], "left")
    none = mix.rows.where("mix_size = 0").withColumn("mix_taken", F.lit(0).cast("long"))
    return some.unionByName(none).fillna(0, ["mix_taken"])


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings
) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document.

    A text taken whole stays as it is; of others the taken words stay, in order,
    with a space between. ``n_chars``, where there is such a column, is counted
    anew. Documents of which the mix takes nothing are not in it.
    """
    names = docs.columns
    held = [f"held_{i}" for i in range(len(names))]
    renamed = docs.toDF(*held)
    at = {name: alias for name, alias in zip(names, held, strict=True)}
    mix = mix_sources(
        renamed, id_col=at[id_col], text_col=at[text_col], source_col=at[source_col], carry=tuple(held), **settings
    )
    piece = F.struct("start", "stop")
    turns = mix.pieces.groupBy("rank", "first", "pass").agg(
        F.sort_array(F.collect_list(piece)).alias("mix_parts"),
        F.sum(F.col("stop") - F.col("start")).alias("mix_taken"),
    )
    turns = turns.withColumnsRenamed({"rank": "mix_rank", "first": "mix_first"}).drop("pass")
    joined = mix.rows.where("mix_size > 0").join(turns, ["mix_rank", "mix_first"])
    text = F.col(at[text_col])
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    part = F.transform(
        "mix_parts",
        lambda p: F.array_join(F.slice(words, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")), " "),
    )
    text = F.when(F.col("mix_taken") == F.col("mix_size"), text).otherwise(F.array_join(part, " "))
    joined = joined.withColumn(at[text_col], text)
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn(at["n_chars"], F.char_length(at[text_col]).cast(kind))
    return joined.select(*[F.col(alias).alias(name) for name, alias in at.items()])
