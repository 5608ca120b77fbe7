"""Expected values kept from the reference's own currency tests and literal fixtures."""

from pyspark.sql import functions as F

from kestrel.functions import scalars as S


def _one(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    return [r[0] for r in df.select(expr(F.col("raw"))).collect()]


def test_detect_currency_symbols(spark):
    vals = ["$100.50", "€100.50", "100€", "£100.50", "₹1,00,000", "A$100.50", "C$100.50", "S$100.50", "12345", "hello"]
    assert _one(spark, S.detect_currency, vals) == ["USD", "EUR", "EUR", "GBP", "INR", "AUD", "CAD", "SGD", None, None]


def test_currency_from_names_and_files():
    assert S.currency_from_text(" ".join(["price_usd", "quantity"])) == "USD"
    assert S.currency_from_text(" ".join(["price_inr", "quantity"])) == "INR"
    assert S.currency_from_text(" ".join(["price", "quantity", "date"])) is None
    assert S.currency_from_text("sales_india_2025.csv") == "INR"
    assert S.currency_from_text("data.csv") is None


def test_parse_money_locales(spark):
    vals = ["$1,234.56", "1.234,56 €", "₹1,00,000", "12,50", "free", None]
    out = _one(spark, lambda c: S.parse_money(c)["amount"], vals)
    assert out[:5] == [1234.56, 1234.56, 100000.0, 12.5, 0.0]


def test_parse_units(spark):
    vals = ["1.5M", "10k", "20MB", "free", "1,000,000+", "12.5%", None]
    assert _one(spark, S.parse_units, vals) == [1.5e6, 1e4, 20.0, None, 1e6, 12.5, None]


def test_mixed_dates_first_format_wins(spark):
    out = _one(spark, S.parse_mixed_date, ["2024-03-05", "05/03/2024", "5 Mar 2024", "March 5, 2024", "bad", None])
    assert [d.strftime("%Y-%m-%d") if d else None for d in out] == [
        "2024-03-05", "2024-05-03", "2024-03-05", "2024-03-05", None, None]


def test_indian_grouping(spark):
    df = spark.createDataFrame([(1234567.5,), (999.0,), (100000.0,)], "x double")
    assert [r[0] for r in df.select(S.indian_grouping("x")).collect()] == ["12,34,567.50", "999.00", "1,00,000.00"]
