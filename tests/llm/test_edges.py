"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
import harness
from tideline.llm import (
    embedding_dedup,
    language_model,
    licences,
    line_dedup,
    mixing,
    packing,
    queries,
    sharding,
    simhash,
    toxicity,
)
from tideline.llm.oracle import LLM_ORACLE
from tideline.llm.queries import LLM_QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("fp", "root", "key", "size", "shard", "slot", "mix_rank", "text_hash", "line", "row", "rank", "first")
ROWS = [
    (1, "one line here\nanother line of words here", "en", "a", 10),
    (1, "one line here\nanother line of words here", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "a text without an id", "en", None, 5),
    (5, "long " * 30_000, "en", "b", 150_000),
    (6, " \n \n", "en", "a", 4),
]


def documents(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({name: F.lit("x") for name in CLASHES})


def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")


OPERATORS = {
    "mixing": lambda s, d: mixing.taken_words(mixing.mix_sources(d)),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "packing": lambda s, d: packing.pack_documents(d, queries.word_tokenizer()),
    "licences": lambda s, d: licences.scan_licences(d, licences.known_licences(s)),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels(s))),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "simhash_dedup": lambda s, d: simhash.simhash_dedup(d),
    "language_model": lambda s, d: language_model.score_documents(
        d, *language_model.fit_language_model(d, ~language_model.held_out(F.col("doc_id")))
    ),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
}
ONE_ROW_EACH = ("mixing", "sharding", "licences", "toxicity", "simhash", "language_model", "line_dedup")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, documents(spark, ROWS)).collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == len(ROWS)
    if name == "simhash_dedup":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 5]
        assert sum(r["doc_id"] is None for r in rows) == 1
        assert {r["fp"] for r in rows} == {"x"}
    if name == "line_dedup":
        assert {r["text"] for r in rows if r["doc_id"] == 2} == {None}
        assert {r["text"] for r in rows if r["doc_id"] == 6} == {" \n \n"}
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_values_of_odd_rows(spark):
    docs = documents(spark, ROWS)
    texts = {i: text or "" for i, text, *_ in ROWS}
    mixed = {r["mix_id"]: r for r in OPERATORS["mixing"](spark, docs).collect()}
    assert {i: r["mix_size"] for i, r in mixed.items()} == {i: len(text.split()) for i, text in texts.items()}
    assert all(0 <= r["mix_taken"] <= 2 * r["mix_size"] for r in mixed.values())
    shards = OPERATORS["sharding"](spark, docs).collect()
    assert sorted((r["size"], r["text_crc32"] is None) for r in shards) == sorted(
        (len((row[1] or "").encode()) + 1, row[1] is None) for row in ROWS
    )
    assert len({r["shard"] for r in shards if r["doc_id"] == 1}) == 1
    assert sorted((r["shard"], r["slot"]) for r in shards) == sorted({(r["shard"], r["slot"]) for r in shards})
    packed = OPERATORS["packing"](spark, docs).collect()
    lengths = {}
    for r in packed:
        lengths.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(lengths) == set(texts)
    assert lengths[2] == lengths[3] == [(0, 0, 1)] and len(lengths[1]) == 2 and len(set(lengths[1])) == 1
    long = sorted(lengths[5])
    assert [start for _, start, _ in long] == [4096 * i for i in range(len(long))] and len(long) > 1
    scored = {r["doc_id"]: r for r in OPERATORS["language_model"](spark, docs).collect()}
    assert {i: r["n_tokens"] for i, r in scored.items()} == {i: len(text.split()) + 1 for i, text in texts.items()}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in scored.values())
    assert all(r["licence"] is None for r in OPERATORS["licences"](spark, docs).collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def test_odd_vectors(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string")
    assert embedding_dedup.embedding_components(vectors).collect() == []
    rows = [(None, [1.0, 2.0], 1, "c"), (1, [1.0, 2.0], 1, "c"), (2, [1.0, 2.0], 1, "c"), (3, [1.0, 2.0], None, "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    found = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_components(vectors).collect()}
    assert found == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_the_columns(spark, number, tmp_path):
    name, stage = corpus_pipeline.STAGES[number]
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.dtypes == docs.dtypes
        if name == "line_dedup":
            assert kept.count() == len(rows)


def test_the_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = {r["doc_id"] for r in rows}
    assert kept and all(r["offset"] + r["length"] <= 4096 for r in rows)
    found = queries.op6_toxicity(spark, "/root/testdata/sf0.001").where("predicted = 1").collect()
    assert not kept & {r["doc_id"] for r in found}


def test_registry_has_every_operator():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    harness_tables = harness.TABLES
    harness.TABLES = (*harness_tables, "documents", "embeddings")
    try:
        connection = harness.duck("/root/testdata/sf0.001")
    finally:
        harness.TABLES = harness_tables
    frame = LLM_QUERIES[name](spark, "/root/testdata/sf0.001")
    assert harness.spark_result(frame) == harness.duck_result(connection, LLM_ORACLE[name])
