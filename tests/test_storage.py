"""Intermediate tables: where they are kept and how long."""

import os

import pytest

from tideline.plans.storage import Scratch, shared_folder


def test_dropped_tables_are_gone_and_what_was_made_of_them_stays(spark):
    scratch = Scratch(spark)
    first = scratch.write(spark.range(10), "first")
    second = scratch.write(first.selectExpr("id * 2 AS id"), "second")
    scratch.drop("first")
    assert sorted(os.listdir(scratch.folder)) == ["second"]
    assert sorted(row.id for row in second.collect()) == list(range(0, 20, 2))


def test_a_name_is_used_once(spark):
    scratch = Scratch(spark)
    scratch.write(spark.range(1), "same")
    with pytest.raises(Exception, match="already exists"):
        scratch.write(spark.range(1), "same")


def test_every_call_has_its_own_folder(spark):
    assert Scratch(spark).folder != Scratch(spark).folder != shared_folder(spark)
