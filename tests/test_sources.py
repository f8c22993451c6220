import datetime as dt
import glob
import os
from types import SimpleNamespace

import pytest
from plans import final_plan, planned

from tideline.operators.cleaning import clean_retail
from tideline.operators.metrics import kyc_rates, tpv
from tideline.operators.product import step_funnel, step_times
from tideline.operators.results import register_views
from tideline.plans.storage import shared_folder
from tideline.sources import (
    create_database,
    curate_product_events,
    curate_retail,
    export_csv,
    read_curated,
    read_raw,
    read_retail_source,
    refresh_partitions,
    register_curated,
    register_raw,
    write_curated,
    write_raw,
)

RETAIL = """Invoice,whatever,the,header,says,is,ignored,here,too
536365,85123A,"WHITE ""HANGING"" HEART, LARGE",6,2010-12-01 08:26:00,2.55,17850,United Kingdom,15.3
536366,71053,,6,2011-01-31 23:59:59,3.39,17850,EIRE,20.34
"""

EVENTS = """user_id,channel,event_name,event_timestamp,amount,is_fraud,kyc_result
U1,pagado,signup,2024-01-01 00:00:07.179575,,,
U1,pagado,first_transaction,2024-01-31 23:59:59.999999,12.5,True,""
U2,organico,complete_kyc,2024-02-01 00:00:00,"",,kyc_approved
U2,organico,repeat_transaction,2024-11-05 10:00:00,3,False,
"""


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as file:
        file.write(text)
    return str(path)


def test_raw_is_text_bound_by_position(spark, tmp_path):
    write(tmp_path, "a.csv", RETAIL)
    write(tmp_path, "b.csv", RETAIL)
    raw = read_raw(spark, str(tmp_path), "online_retail")
    assert {field.dataType.simpleString() for field in raw.schema} == {"string"}
    rows = raw.orderBy("invoice_no").collect()
    assert len(rows) == 4  # both headers skipped
    assert rows[0].description == 'WHITE "HANGING" HEART, LARGE'
    assert rows[2].description is None
    assert rows[0].total_price == "15.3"


def test_raw_tables_in_the_catalog(spark, tmp_path):
    write(tmp_path, "a.csv", "channel,month,acquisition_cost_pen\norganico,2024-01,1616.39\n")
    create_database(spark, "raw_layer")
    register_raw(spark, "raw_layer.costs", str(tmp_path), "acquisition_costs")
    register_raw(spark, "raw_layer.costs", str(tmp_path), "acquisition_costs")
    assert [tuple(row) for row in spark.table("raw_layer.costs").collect()] == [
        ("organico", "2024-01", "1616.39")
    ]


def test_retail_sources_are_joined_by_name(spark, tmp_path):
    one = write(tmp_path, "one.csv", "Invoice,Price,Description\n1,2.5,café\n", "iso-8859-1")
    two = write(tmp_path, "two.csv", "Description,Invoice,Extra\nb,2,x\n", "iso-8859-1")
    rows = read_retail_source(spark, [one, two]).orderBy("Invoice").collect()
    assert [row.asDict() for row in rows] == [
        {"Invoice": "1", "Price": "2.5", "Description": "café", "Extra": None},
        {"Invoice": "2", "Price": None, "Description": "b", "Extra": "x"},
    ]


def test_retail_source_with_line_breaks(spark, tmp_path):
    path = write(tmp_path, "one.csv", 'Invoice,Description\n1,"two\nlines"\n')
    (row,) = read_retail_source(spark, path, multi_line=True).collect()
    assert row.Description == "two\nlines"
    with pytest.raises(ValueError):
        read_retail_source(spark, [])


def test_files_of_one_source_share_a_header(spark, tmp_path):
    os.mkdir(tmp_path / "source")
    write(tmp_path / "source", "a.csv", "Invoice,Price\n1,2.5\n")
    write(tmp_path / "source", "b.csv", "Invoice,Price\n2,3.5\n")
    frame = read_retail_source(spark, str(tmp_path / "source"))
    assert sorted(tuple(row) for row in frame.collect()) == [("1", "2.5"), ("2", "3.5")]
    write(tmp_path / "source", "c.csv", "Price,Invoice\n2.5,3\n")
    with pytest.raises(Exception, match="header"):
        read_retail_source(spark, str(tmp_path / "source")).collect()


def test_retail_is_typed(spark, tmp_path):
    write(tmp_path, "a.csv", RETAIL)
    curated = curate_retail(read_raw(spark, str(tmp_path), "online_retail"))
    assert [(f.name, f.dataType.simpleString()) for f in curated.schema] == [
        ("invoice_no", "string"),
        ("stock_code", "string"),
        ("description", "string"),
        ("quantity", "int"),
        ("invoice_date", "timestamp_ntz"),
        ("unit_price", "double"),
        ("customer_id", "bigint"),
        ("country", "string"),
        ("total_price", "double"),
        ("year", "string"),
        ("month", "string"),
    ]
    row = curated.orderBy("invoice_no").collect()[1]
    assert (row.invoice_date, row.year, row.month) == (dt.datetime(2011, 1, 31, 23, 59, 59), "2011", "1")


def test_events_are_typed(spark, tmp_path):
    write(tmp_path, "a.csv", EVENTS)
    curated = curate_product_events(read_raw(spark, str(tmp_path), "product_events"))
    first, paid, checked, repeat = curated.orderBy("event_timestamp").collect()
    assert first.event_timestamp == dt.datetime(2024, 1, 1, 0, 0, 7)
    assert (first.amount, first.is_fraud, first.kyc_result) == (None, None, None)
    assert (paid.amount, paid.is_fraud, paid.kyc_result) == (12.5, True, None)
    assert paid.event_timestamp == dt.datetime(2024, 1, 31, 23, 59, 59)
    assert (checked.amount, checked.kyc_result) == (None, "kyc_approved")
    assert (repeat.is_fraud, repeat.month) == (False, "11")


@pytest.mark.parametrize(
    "broken",
    [
        "U1,c,signup,2024/01/01 00:00:00,,,\n",
        "U1,c,signup,2024-01-01 00:00:00,x,,\n",
        "U1,c,signup,2024-01-01 00:00:00,,maybe,\n",
    ],
)
def test_malformed_events_raise(spark, tmp_path, broken):
    write(tmp_path, "a.csv", "header\n" + broken)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP"):
        curate_product_events(read_raw(spark, str(tmp_path), "product_events")).collect()


@pytest.fixture
def curated_path(spark, tmp_path):
    write(tmp_path, "a.csv", EVENTS)
    raw = read_raw(spark, str(tmp_path / "a.csv"), "product_events")
    path = str(tmp_path / "curated")
    write_curated(curate_product_events(raw), path, cluster_by=["event_name"])
    return path


def test_curated_round_trip(spark, curated_path):
    frame = read_curated(spark, curated_path, "product_events")
    assert sorted(os.path.basename(p) for p in glob.glob(f"{curated_path}/year=2024/*")) == [
        "month=1",
        "month=11",
        "month=2",
    ]
    assert frame.schema["month"].dataType.simpleString() == "string"
    assert frame.count() == 4
    assert glob.glob(f"{curated_path}/year=2024/month=1/*.snappy.parquet")


def test_partitions_and_filters_reach_the_scan(spark, curated_path):
    frame = read_curated(spark, curated_path, "product_events")
    month = planned(frame.filter("year = '2024' AND month = '1'"))
    assert "PartitionFilters: [isnotnull(year" in month
    for operator in (step_funnel, step_times, kyc_rates, tpv):
        plan = final_plan(operator(frame))
        assert "PushedFilters: [" in plan and "event_name" in plan.split("PushedFilters: [")[1]
    read = final_plan(tpv(frame)).split("ReadSchema: ")[1].split("\n")[0]
    assert "channel" not in read and "kyc_result" not in read


def test_existing_tables_are_not_overwritten(spark, curated_path):
    frame = read_curated(spark, curated_path, "product_events")
    with pytest.raises(Exception, match="already exists"):
        write_curated(frame, curated_path)


def test_added_partitions_are_registered(spark, curated_path):
    create_database(spark, "curated_layer")
    register_curated(spark, "curated_layer.events", curated_path, "product_events")
    refresh_partitions(spark, "curated_layer.events")
    assert spark.table("curated_layer.events").count() == 4
    more = read_curated(spark, curated_path, "product_events").filter("month = '2'").drop("year", "month")
    more.write.parquet(f"{curated_path}/year=2025/month=3")
    refresh_partitions(spark, "curated_layer.events")
    assert spark.table("curated_layer.events").filter("year = '2025'").count() == 1


@pytest.mark.parametrize("cluster_by", [[], ["event_name", "user_id"]])
def test_a_large_month_is_split_over_files(spark, tmp_path, cluster_by):
    rows = spark.range(60000).selectExpr(
        "cast(id as string) AS user_id",
        "'c' AS channel",
        "'login' AS event_name",
        "timestamp_ntz'2024-03-01 00:00:00' AS event_timestamp",
        "cast(id as double) AS amount",
        "true AS is_fraud",
        "uuid() AS kyc_result",
        "'2024' AS year",
        "if(id % 3 = 0, '4', '3') AS month",
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        write_curated(rows.repartition(16), str(tmp_path / "t"), cluster_by=cluster_by)
    finally:
        spark.conf.set(size, before)
    files = glob.glob(str(tmp_path / "t/year=2024/month=3/*.parquet"))
    assert len(files) > 1
    assert read_curated(spark, str(tmp_path / "t"), "product_events").count() == 60000


def test_cleaned_lines_survive_the_raw_layer(spark, tmp_path):
    source = write(
        tmp_path,
        "source.csv",
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '536365,85123A,"say ""hi"", ok",6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom\n'
        "C536366,71053,x,6,2010-12-01 08:26:00,3.39,17850.0,EIRE\n"
        "536367,71053,x,6,2010-12-01 08:26:00,3.39,,EIRE\n",
    )
    write_raw(clean_retail(read_retail_source(spark, source)), str(tmp_path / "raw"))
    (row,) = curate_retail(read_raw(spark, str(tmp_path / "raw"), "online_retail")).collect()
    assert tuple(row) == (
        "536365",
        "85123A",
        'say "hi", ok',
        6,
        dt.datetime(2010, 12, 1, 8, 26),
        2.55,
        17850,
        "United Kingdom",
        6 * 2.55,
        "2010",
        "12",
    )


def test_export_quotes_everything(spark, tmp_path):
    result = spark.sql(
        "SELECT date'2009-12-01' AS cohort_month, 955L AS n, 100.0D AS pct, "
        "timestamp_ntz'2010-01-02 03:04:05.678' AS at, 'a, \"b\"' AS text, cast(null AS string) AS channel"
    )
    export_csv(result, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out/part-*.csv"))
    with open(part) as file:
        assert file.read() == (
            '"cohort_month","n","pct","at","text","channel"\n'
            '"2009-12-01 00:00:00.000","955","100.0","2010-01-02 03:04:05.678","a, ""b""",""\n'
        )


def test_round_trips_use_the_shared_folder(tmp_path):
    def session(**settings):
        return SimpleNamespace(conf=settings)

    shared = session(**{"spark.checkpoint.dir": "hdfs://lake/checkpoints/"})
    one, two = shared_folder(shared), shared_folder(shared)
    assert one.startswith("hdfs://lake/checkpoints/tideline-") and one != two
    assert os.path.isdir(shared_folder(session()))


def test_views_for_sql_users(spark, curated_path, tmp_path):
    write(tmp_path, "retail.csv", RETAIL)
    lines = curate_retail(read_raw(spark, str(tmp_path / "retail.csv"), "online_retail"))
    register_views(lines, read_curated(spark, curated_path, "product_events"))
    assert spark.table("v_first_purchase").count() == 1
    assert spark.sql("SELECT sum(dau) FROM v_dau").first()[0] == 4
    rows = spark.sql("SELECT month, amount FROM v_monthly_transactions ORDER BY month").collect()
    assert [tuple(row) for row in rows] == [("2024-01", 12.5), ("2024-11", 3.0)]
