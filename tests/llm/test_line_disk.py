"""What line dedup moves for its keys, and the files that written tables leave."""

import time

from plans import planned
from pyspark.sql import functions as F

from tideline.llm import line_dedup, mixing
from tideline.plans.storage import Scratch


def test_lines_move_once_for_their_keys(spark, monkeypatch):
    plans, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, frame, name: plans.update({name: planned(frame)}) or write(self, frame, name))
    docs = spark.createDataFrame([(1, "some words of a line"), (2, "other words of a line")], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 2
    assert plans["members"].count("hashpartitioning(key") == 1


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {kept.apply(i).getName() for i in range(kept.size()) if kept.apply(i).getName().startswith("shuffle_")}

    before, scratch = files(), Scratch(spark)
    table = scratch.write(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "sevens")
    for _ in range(50):
        if not any(name.endswith(".data") for name in files() - before):
            break
        time.sleep(0.1)
    else:
        raise AssertionError("shuffle files stay")
    assert table.count() == 7 and sorted(r["count"] for r in table.collect())[0] == 142
    scratch.drop("sevens")


def test_mixing_keeps_one_table_of_the_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "shared_folder", lambda _: str(tmp_path / "mix"))
    docs = spark.createDataFrame([(i, "some words of a text", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).rows.count() == 40
    assert not (tmp_path / "mix" / "sized").exists() and (tmp_path / "mix" / "rows").exists()
