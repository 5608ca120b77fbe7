"""Column-level scalar functions.

All are built-in Spark expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Tokens read as missing in CSV scans ('' NA N/A null NULL plus pandas' defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Currency codes with their USD rate (1 unit = rate USD).
FX_RATES_TO_USD = {"USD": 1.0, "EUR": 1.05, "GBP": 1.27, "INR": 0.01136, "JPY": 0.0067,
                   "AUD": 0.65, "CAD": 0.74, "CHF": 1.13, "CNY": 0.14, "SGD": 0.74}
# Keywords naming a currency in column names or file names, in precedence order.
CURRENCY_KEYWORDS = [
    ("USD", ["usd", "dollar", "us$", "united states"]),
    ("EUR", ["eur", "euro", "€"]),
    ("GBP", ["gbp", "pound", "sterling", "£", "british"]),
    ("INR", ["inr", "rupee", "rupees", "₹", "indian", "india"]),
    ("JPY", ["jpy", "yen", "¥", "japan"]),
    ("AUD", ["aud", "australian", "australia"]),
    ("CAD", ["cad", "canadian", "canada"]),
    ("CHF", ["chf", "franc", "swiss"]),
    ("CNY", ["cny", "yuan", "rmb", "chinese", "china"]),
    ("SGD", ["sgd", "singapore"]),
]
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥",
                    "AUD": "A$", "CAD": "C$", "CHF": "CHF", "CNY": "¥", "SGD": "S$"}
# Date formats tried in order (first match wins): Python %Y-%m-%d, %d-%m-%Y,
# %m/%d/%Y, %d/%m/%Y, %Y/%m/%d, %d %b %Y, %d %B %Y, %B %d, %Y, %b %d, %Y.
DATE_FORMATS = ["yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d",
                "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
TRUE_VALUES = ["true", "yes", "y", "1", "on", "active"]
FALSE_VALUES = ["false", "no", "n", "0", "off", "inactive"]
NULL_UNIT_WORDS = ["varies with device", "varies", "free", "nan", "", "n/a"]
SEVERITY_ORDER = {"low": 1, "medium": 2, "high": 3}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def na_to_null(c, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """A1: string cell equal (after trim) to an NA token becomes null."""
    c = _c(c)
    return F.when(F.trim(c).isin(list(tokens)), F.lit(None)).otherwise(c)


def clean_numeric(c) -> Column:
    """H3: strip ₹ $ € £ , whitespace and % and cast to double (bad -> null)."""
    s = F.regexp_replace(_c(c).cast("string"), r"[₹$€£,\s%]", "")
    return s.try_cast("double")


def parse_units(c) -> Column:
    """H4: numbers with k/m/b/t/g multipliers, ``+``, ``%``, money symbols.

    ``mb``/``kb``/``gb`` are checked before the one-letter suffixes (the
    reference's order made them unreachable).  Words such as "free" -> null.
    """
    s = F.lower(F.trim(_c(c).cast("string")))
    s2 = F.regexp_replace(s, r"[$€£+%,]", "")
    num = F.regexp_extract(s2, r"^(-?[0-9]*\.?[0-9]+)\s*([a-z]*)$", 1).try_cast("double")
    unit = F.regexp_extract(s2, r"^(-?[0-9]*\.?[0-9]+)\s*([a-z]*)$", 2)
    mult = (F.when(unit == "", 1.0).when(unit == "mb", 1.0).when(unit == "kb", 1e-3).when(unit == "gb", 1e3)
            .when(unit == "t", 1e12).when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3)
            .when(unit == "g", 1e9))
    return F.when(s.isNull() | s.isin(NULL_UNIT_WORDS), F.lit(None).cast("double")).otherwise(num * mult)


def detect_currency(c, default: str | None = None) -> Column:
    """H6: currency code from a value; precedence A$, C$, S$, CHF, then € £ ₹ $ ¥."""
    s = F.trim(_c(c).cast("string"))
    u = F.upper(s)
    out = (F.when(s.startswith("A$") | u.contains("AUD"), "AUD")
           .when(s.startswith("C$") | u.contains("CAD"), "CAD")
           .when(s.startswith("S$") | u.contains("SGD"), "SGD")
           .when(u.contains("CHF"), "CHF")
           .when(s.contains("€"), "EUR")
           .when(s.contains("£"), "GBP")
           .when(s.contains("₹"), "INR")
           .when(s.contains("$"), "USD")
           .when(s.contains("¥") & ~s.contains("."), "JPY")
           .when(s.contains("¥"), "CNY"))
    return out if default is None else F.coalesce(out, F.lit(default))


def parse_money(c, default_currency: str | None = None) -> Column:
    """H5: ``struct(amount double, currency string)`` with locale rules.

    Symbols are removed as tokens (not a character class, which would also
    eat letters A C S H F).  Both separators: the later one is the decimal
    mark.  A single comma followed by exactly two digits is a decimal comma.
    Unparseable -> 0.0 as in the reference.
    """
    s = _c(c).cast("string")
    cur = F.coalesce(detect_currency(s), F.lit(default_currency or "USD"))
    clean = F.regexp_replace(s, r"A\$|C\$|S\$|CHF|[₹$€£¥]|\s", "")
    euro = clean.rlike(r"\.[^.]*,[^.]*$")
    has_c, has_d = clean.contains(","), clean.contains(".")
    both = F.when(euro, F.regexp_replace(F.regexp_replace(clean, r"\.", ""), ",", ".")).otherwise(
        F.regexp_replace(clean, ",", ""))
    comma_only = F.when(clean.rlike(r"^[^,]*,[^,]{2}$"), F.regexp_replace(clean, ",", ".")).otherwise(
        F.regexp_replace(clean, ",", ""))
    norm = F.when(has_c & has_d, both).when(has_c, comma_only).otherwise(clean)
    amount = F.coalesce(norm.try_cast("double"), F.lit(0.0))
    return F.struct(amount.alias("amount"), cur.alias("currency"))


def currency_from_text(text: str) -> str | None:
    """H7 helper for column names and file names (driver-side strings only)."""
    low = text.lower()
    for code, kws in CURRENCY_KEYWORDS:
        if any(k in low for k in kws):
            return code
    return None


def fx_convert(amount, from_rate, to_rate) -> Column:
    """H8: convert via the USD pivot: amount * from_rate / to_rate."""
    return _c(amount) * _c(from_rate) / _c(to_rate)


def format_number(c, kind: str = "decimal", decimals: int = 2, currency: str = "USD") -> Column:
    """Decimal (grouped), currency (symbol prefix), percentage, integer."""
    x = _c(c).cast("double")
    if kind == "integer":
        return F.format_number(F.round(x, 0), 0)
    if kind == "percentage":
        return F.concat(F.format_number(x, decimals), F.lit("%"))
    if kind == "currency":
        return F.concat(F.lit(CURRENCY_SYMBOLS.get(currency, "$")), F.format_number(x, decimals))
    return F.format_number(x, decimals)


def indian_grouping(c) -> Column:
    """1234567.5 -> '12,34,567.50' (last three digits, then pairs)."""
    x = _c(c).cast("double")
    fixed = F.format_string("%.2f", x)
    ip = F.substring_index(fixed, ".", 1)
    dp = F.substring_index(fixed, ".", -1)
    n = F.length(ip)
    head = F.regexp_replace(_substr(ip, 1, n - 3), r"(\d)(?=(\d{2})+$)", "$1,")
    tail = _substr(ip, n - 2, 3)
    return F.when((x < 1000) | (n <= 3), fixed).otherwise(F.concat(head, F.lit(","), tail, F.lit("."), dp))


def _substr(s: Column, pos, length) -> Column:
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    length = length if isinstance(length, Column) else F.lit(length)
    return s.substr(pos, length)


def parse_mixed_date(c, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins (ambiguous d/m vs m/d follow the
    list order); unparseable -> null."""
    s = F.trim(_c(c).cast("string"))
    first = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    # a failing parse is dear, and each of the usual forms has two groups of digits
    return F.when(s.rlike(r"\d\D+\d"), first) if formats is DATE_FORMATS else first


def normalize_date_string(c, out_format: str = "yyyy-MM-dd", formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Re-format parseable dates, return unparsed values as they are."""
    return F.coalesce(F.date_format(parse_mixed_date(c, formats), out_format), _c(c).cast("string"))


def date_parts(c, prefix: str) -> dict[str, Column]:
    """Year, month, day, hour, day of week (Monday=0, S10), weekend flag."""
    t = _c(c).cast("timestamp")
    dow = F.weekday(t)
    return {f"{prefix}_year": F.year(t), f"{prefix}_month": F.month(t), f"{prefix}_day": F.dayofmonth(t),
            f"{prefix}_hour": F.hour(t), f"{prefix}_dayofweek": dow,
            f"{prefix}_is_weekend": (dow >= 5).cast("int")}


def cyclic(c, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2·pi·x/period."""
    x = _c(c).cast("double")
    return F.sin(2 * math.pi * x / period), F.cos(2 * math.pi * x / period)


def parse_bool(c) -> Column:
    """{true,yes,y,1,on,active} -> true, {false,...} -> false, else null."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.when(s.isin(TRUE_VALUES), True).when(s.isin(FALSE_VALUES), False)


def clip(c, lo, hi) -> Column:
    """greatest(least(x, hi), lo)."""
    return F.greatest(F.least(_c(c), hi), lo)


def row_stats(cols: Sequence[str]) -> dict[str, Column]:
    """Per-row mean, population std, min, max, range, median, skew, kurtosis
    over numeric columns (nulls ignored), with array higher-order functions."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    n = F.size(arr).cast("double")
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n
    m2 = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    m3 = F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.pow(v - mean, 3)) / n
    m4 = F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.pow(v - mean, 4)) / n
    srt = F.array_sort(arr)
    k = F.size(srt)
    median = F.when(k % 2 == 1, F.element_at(srt, (k / 2 + 0.5).cast("int"))).otherwise(
        (F.element_at(srt, (k / 2).cast("int")) + F.element_at(srt, (k / 2 + 1).cast("int"))) / 2)
    return {"row_mean": mean, "row_std": F.sqrt(m2), "row_min": F.array_min(arr), "row_max": F.array_max(arr),
            "row_range": F.array_max(arr) - F.array_min(arr), "row_median": median,
            "row_skew": F.when(m2 > 0, m3 / F.pow(m2, 1.5)), "row_kurtosis": F.when(m2 > 0, m4 / (m2 * m2) - 3)}


def in_quiet_hours(ts, start_minute: int, end_minute: int) -> Column:
    """Minute-of-day inside [start, end], wrapping midnight when start > end."""
    t = _c(ts).cast("timestamp")
    m = F.hour(t) * 60 + F.minute(t)
    if start_minute <= end_minute:
        return (m >= start_minute) & (m <= end_minute)
    return (m >= start_minute) | (m <= end_minute)


def severity_at_least(c, threshold: str) -> Column:
    """Ordinal low < medium < high comparison."""
    m = F.create_map(*[x for k, v in SEVERITY_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.lower(_c(c))], F.lit(0)) >= SEVERITY_ORDER[threshold]


def json_field(c, path: str, cast: str | None = None) -> Column:
    """Value at a JSON path of a string column."""
    v = F.get_json_object(_c(c), path)
    return v.try_cast(cast) if cast else v


def fiscal_quarter(c, fiscal_year_end_month: int = 12) -> Column:
    """Quarter of the fiscal year ending in ``fiscal_year_end_month``."""
    start = fiscal_year_end_month % 12 + 1
    return (F.floor(F.pmod(F.month(_c(c)) - start, F.lit(12)) / 3) + 1).cast("int")


# ------------------------------------------------------------- text scalars (N)


def clean_whitespace(c) -> Column:
    """Collapse runs of spaces/tabs, at most two newlines, strip white space."""
    s = F.regexp_replace(_c(c), r"[ \t]+", " ")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"\A\s+|\s+\z", "")


def analysis_text(c) -> Column:
    """Lower case, unescape basic HTML entities, drop URLs, e-mails and
    punctuation, collapse spaces."""
    s = F.lower(_c(c))
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.regexp_replace(s, r"https?://\S+|www\.\S+", " ")
    s = F.regexp_replace(s, r"\S+@\S+\.\S+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sanitize(c, max_chars: int | None = None) -> Column:
    """Drop control characters (keeping tab/newline); cut only when asked to."""
    s = F.regexp_replace(_c(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return s if max_chars is None else F.substring(s, 1, max_chars)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))
