"""Column-to-role matching."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Role:
    exact: tuple[str, ...]
    contains: tuple[str, ...]
    patterns: tuple[str, ...]
    weight: float


# fixed values: names, patterns and weights of the business roles, in order; of equal scores the first role counts
ROLES = {
    "amount": Role(("amount", "revenue", "sales", "total", "price", "value", "cost", "payment", "income", "profit"),
                   ("amount", "revenue", "sales", "total", "price", "value", "cost", "usd", "inr", "eur", "gbp", "contract"),
                   (r".*_amount$", r".*_price$", r".*_value$", r".*_total$", r".*_revenue$", r"annual.*value"), 1.0),
    "customer": Role(("customer", "client", "company", "buyer", "account", "customer_name", "client_name"),
                     ("customer", "client", "company", "buyer", "account", "name"),
                     (r".*customer.*", r".*client.*", r".*company.*name.*"), 0.9),
    "product": Role(("product", "item", "sku", "service", "goods", "product_name", "item_name"),
                    ("product", "item", "sku", "service", "goods", "description"),
                    (r".*product.*", r".*item.*", r".*service.*"), 0.9),
    "date": Role(("date", "order_date", "transaction_date", "created_at", "timestamp", "created", "ordered"),
                 ("date", "timestamp", "created", "ordered", "time"), (r".*date$", r".*_at$", r".*time.*"), 0.8),
    "quantity": Role(("quantity", "qty", "units", "count", "volume", "num", "number"),
                     ("quantity", "qty", "units", "count", "volume"), (r".*qty.*", r".*quantity.*", r".*count.*", r".*units.*"), 0.7),
    "category": Role(("category", "type", "segment", "industry", "sector", "group"),
                     ("category", "type", "segment", "industry", "sector"), (r".*category.*", r".*segment.*", r".*industry.*"), 0.6),
    "region": Role(("region", "country", "location", "city", "state", "area", "territory"),
                   ("region", "country", "location", "city", "state", "geo"), (r".*region.*", r".*country.*", r".*location.*"), 0.6),
    "id": Role(("id", "invoice_id", "order_id", "transaction_id", "customer_id", "product_id"), ("_id", "number", "no.", "num"),
               (r".*_id$", r".*_no$", r".*_number$"), 0.5),
}
ASSIGNED = ("amount", "customer", "product", "date", "quantity", "category", "region")  # fixed order of the assignment
CURRENCY_MARKS = ("$", "€", "£", "₹", "¥", "USD", "EUR", "GBP", "INR", "JPY")
DATE_FORMS = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
LEAST = 0.3  # a role needs more


def name_score(column: str, role: str) -> float:
    """Equal to a name 1, holding a part 0.8, matching a pattern 0.7, else 0.6 times the
    likeness to the nearest name if that is over 0.6; times the role's weight."""
    name, r = column.lower().strip().replace(" ", "_"), ROLES[role]
    if name in r.exact:
        return 1.0 * r.weight
    if any(p in name for p in r.contains):
        return 0.8 * r.weight
    if any(re.match(p, name) for p in r.patterns):
        return 0.7 * r.weight
    likeness = max(SequenceMatcher(None, name, p).ratio() for p in r.exact)
    return likeness * 0.6 * r.weight if likeness > 0.6 else 0.0


def _evidence(c: Column, kind: T.DataType) -> dict[str, Column]:
    """Conditions on a value that count for a role."""
    text = c.cast("string")
    valid = c.isNotNull() & (F.trim(text) != "") & (F.lower(text) != "nan")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        number = x > 0
        currency = date = F.lit(False)
    else:
        x = text.try_cast("double")
        number = F.regexp_replace(text, r"[^\d.-]", "").try_cast("double") > 0
        currency, date = F.lit(False), text.rlike(DATE_FORMS)
        for mark in CURRENCY_MARKS:
            currency = currency | text.contains(mark)
    small = (x == F.floor(x)) & (x > 0) & (x < 10000)
    return {"valid": valid, "currency": valid & currency, "number": valid & F.coalesce(number, F.lit(False)),
            "date": valid & date, "small": valid & F.coalesce(small, F.lit(False)), "null": c.isNull()}


SHARES = ("currency", "number", "date", "small")


def value_shares(df: DataFrame) -> DataFrame:
    """Per column the share of its values (not null, blank or nan) with a currency mark,
    that are positive numbers, that look like dates, that are small whole numbers, and
    its nulls: one aggregate over the whole table."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    parts = [_evidence(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(v).alias(f"{k}{i}") for i, p in enumerate(parts) for k, v in p.items()])
    long = row.select("rows", F.explode(F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.col(f"null{i}").alias("nulls"), F.col(f"valid{i}").alias("valid"),
        *[F.try_divide(f"{k}{i}", f"valid{i}").alias(k) for k in SHARES]) for i, f in enumerate(fields)])).alias("e"))
    return long.select("rows", "e.*")


def role_scores(df: DataFrame) -> DataFrame:
    """Every column with every role its name speaks for: name score, boost from the
    values, score (1 at most).  A row per column and role; names are scored once, on the
    driver, as they are the table's schema."""
    spark = df.sparkSession
    names = [(f.name, role, k, s) for f in df.schema.fields for k, role in enumerate(ROLES) if (s := name_score(f.name, role)) > 0]
    rules = spark.createDataFrame(names, "column string, role string, nth int, name_score double")
    boost = (F.when((F.col("role") == "amount") & (F.col("currency") > 0.3), 0.3)
             .when((F.col("role") == "amount") & (F.col("number") > 0.8), 0.15)
             .when((F.col("role") == "date") & (F.col("date") > 0.5), 0.2)
             .when((F.col("role") == "quantity") & (F.col("small") > 0.8), 0.1).otherwise(0.0))
    return value_shares(df).join(rules, "column").select(
        "column", "place", "role", "nth", "name_score", boost.alias("boost"), F.least(F.lit(1.0), F.col("name_score") + boost).alias("score"))


def match_roles(df: DataFrame) -> DataFrame:
    """(role, column, score), each role and each column at most once.

    A column stands for its best role (of equal scores the first one); roles are then
    filled in their fixed order by their best free column (of equal scores the first of
    the table).  As a column has one role, taking the best per role is that assignment."""
    best = role_scores(df).groupBy("column", "place").agg(F.max(F.struct("score", (-F.col("nth")).alias("o"), "role")).alias("b"))
    ranked = best.where(F.col("b.score") > LEAST).where(F.col("b.role").isin(*ASSIGNED))
    return ranked.groupBy(F.col("b.role").alias("role")).agg(F.max(F.struct(F.col("b.score").alias("score"), (-F.col("place")).alias("o"), "column")).alias("m")).select(
        "role", "m.column", "m.score")


def table_profile(df: DataFrame) -> DataFrame:
    """One row: kind of table, mode of analysis and completeness (0 to 100, cells that
    are not null) from the matched roles."""
    roles = match_roles(df).agg(F.collect_set("role")).scalar()
    has = {r: F.array_contains(roles, r) for r in ASSIGNED}
    sums = value_shares(df).agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("nulls"))
    kind = (F.when(has["amount"] & (has["customer"] | has["product"]), "sales_data")
            .when(has["quantity"] & has["product"], "inventory_data").when(has["customer"] & ~has["amount"], "customer_data")
            .when(has["product"] & ~has["amount"], "product_catalog").otherwise("general_data"))
    full = F.floor((1 - F.try_divide("nulls", F.col("rows") * F.col("columns"))) * 100).cast("int")
    return sums.select(kind.alias("data_type"), F.when(kind == "sales_data", "revenue").when(kind == "inventory_data", "quantity").otherwise("count").alias(
        "analysis_mode"), "rows", F.col("columns"), full.alias("completeness"), *[has[r].alias(f"has_{r}") for r in ASSIGNED])
