import datetime as dt

import pytest

from tideline.operators.cleaning import clean_retail, clean_retail_stats, normalize_retail_columns

HEADER = (
    "Invoice string, StockCode string, Description string, Quantity {q}, InvoiceDate string, "
    "Price double, `Customer ID` {c}, Country string"
)


@pytest.fixture
def source(spark):
    def build(*rows, q="int", c="double"):
        return spark.createDataFrame(list(rows), HEADER.format(q=q, c=c))

    return build


def line(invoice="1", quantity=2, price=1.5, customer=7.0, date="2010-12-01 08:26:00"):
    return (invoice, "S", "a thing", quantity, date, price, customer, "France")


def kept(frame):
    return [row.InvoiceNo for row in clean_retail(frame).collect()]


def test_names_are_normalized(source):
    frame = normalize_retail_columns(source(line()).withColumnRenamed("Country", " Country "))
    assert frame.columns == [
        "InvoiceNo",
        "StockCode",
        "Description",
        "Quantity",
        "InvoiceDate",
        "UnitPrice",
        "CustomerID",
        "Country",
    ]


def test_missing_columns_are_named(source):
    with pytest.raises(ValueError, match=r"\['Quantity', 'Country'\]"):
        normalize_retail_columns(source(line()).drop("Quantity", "Country"))


def test_types_and_total(source):
    (row,) = clean_retail(source(line())).collect()
    assert tuple(row) == ("1", "S", "a thing", 2, dt.datetime(2010, 12, 1, 8, 26), 1.5, 7, "France", 3.0)


def test_text_sources_are_typed_too(source):
    frame = source(line(quantity="6", customer="17850.0"), line("2", quantity="6", customer=""), q="string", c="string")
    (row,) = clean_retail(frame).collect()
    assert (row.Quantity, row.CustomerID, row.TotalPrice) == (6, 17850, 9.0)


def test_other_date_formats(source):
    (row,) = clean_retail(source(line(date="12/1/2010 8:26")), date_format="M/d/yyyy H:mm").collect()
    assert row.InvoiceDate == dt.datetime(2010, 12, 1, 8, 26)


def test_each_rule_drops(source):
    frame = source(
        line("keep"),
        line("nobody", customer=None),
        line("nan", customer=float("nan")),
        line("C1"),
        line("return", quantity=-1),
        line("nothing", quantity=0),
        line("free", price=0.0),
        line("1C"),
    )
    assert kept(frame) == ["keep", "1C"]


def test_unknown_numbers_and_invoices_stay(source):
    frame = source(
        line("noprice", price=None),
        line("nanprice", price=float("nan")),
        line("noquantity", quantity=None),
        line(None),
        line("x", quantity=None, price=-1.0),
    )
    rows = clean_retail(frame).collect()
    assert [row.InvoiceNo for row in rows] == ["noprice", "nanprice", "noquantity", None]
    assert [row.TotalPrice for row in rows] == [None, None, None, 3.0]


def test_a_line_counts_for_the_first_rule_it_breaks(source):
    frame = source(
        line("keep"),
        line("C1", customer=None, quantity=-1),
        line("C2", quantity=-1),
        line("3", price=0.0),
        line("4", price=None),
    )
    (row,) = clean_retail_stats(frame).collect()
    assert row.asDict() == {
        "filas_originales": 5,
        "filas_sin_customer_id_descartadas": 1,
        "filas_canceladas_descartadas": 1,
        "filas_cantidad_o_precio_no_positivo_descartadas": 1,
        "filas_finales": 2,
        "total_filas_descartadas": 3,
    }


def test_stats_of_nothing(source):
    (row,) = clean_retail_stats(source(line()).limit(0)).collect()
    assert tuple(row) == (0, 0, 0, 0, 0, 0)


def test_malformed_numbers_raise(source):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_retail(source(line(customer="abc"), c="string")).collect()


def test_fractional_quantities_raise(source):
    with pytest.raises(Exception, match="not a whole number"):
        clean_retail(source(line(quantity=2.5), q="double")).collect()
