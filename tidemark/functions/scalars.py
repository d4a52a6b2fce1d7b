"""Scalar expressions: strings, hosts, timestamps, numbers, canonical JSON and hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.profiles import FUTURE_SECONDS, GATE_TOLERANCE
from tidemark.schema import PIL_FIELDS

_BLANKS = " \t\n\r"
MERCHANT_BYTES = 256


@F.pandas_udf(T.StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None else unicodedata.normalize("NFC", v).strip(_BLANKS).casefold() for v in s], dtype=object)


def normalize_string(c: Column) -> Column:
    """NFC, stripped of space, tab, line feed and carriage return, case-folded; null is empty. ASCII stays in the JVM."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    plain = text.rlike(r"^[\x00-\x7F]*$")
    # rows that are ASCII reach the Arrow function as null, which it skips
    return F.when(plain, F.lower(F.btrim(text, F.lit(_BLANKS)))).otherwise(_fold(F.when(~plain, text)))


def extract_host(url: Column) -> Column:
    """The host of a URL with an authority, without user and port, IPv6 without brackets, normalized; null if none."""
    lead = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?"
    host = F.coalesce(F.nullif(F.regexp_extract(url, lead + r"\[([^\]/?#]*)\]", 1), F.lit("")), F.regexp_extract(url, lead + r"([^/?#:@\[\]]*)", 1))
    return F.nullif(F.lower(F.btrim(host, F.lit(_BLANKS))), F.lit(""))


_TIME = r"(?:.(\d{2})(?:(:?)(\d{2})(?:\%d(\d{2})(?:[.,]\d+)?)?)?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
_DATE_TIME = r"^(\d{4})(-?)(\d{2})\2(\d{2})" + _TIME % 6
_WEEK_TIME = r"^(\d{4})(-?)W(\d{2})(?:\2(\d))?" + _TIME % 6


def _let(values: list[Column], f) -> Column:
    """f of values that are computed once."""
    return F.get(F.transform(F.array(F.array(*values)), lambda v: f(*[v[i] for i in range(len(values))])), 0)


def _seconds_of(year, month, day, week, weekday, hour, minute, second, zone) -> Column:
    """Epoch seconds of texts of a date and a time; null if there is no such date or time."""
    days = lambda m, d: F.unix_date(F.concat_ws("-", year, m, d).try_cast("date")).cast("long")
    # week 1 holds January 4; a week belongs to the year of its Thursday
    fourth = days(F.lit("01"), F.lit("04"))
    thursday = fourth - F.pmod(fourth + 3, F.lit(7)) + (week.cast("long") - 1) * 7 + 3
    real = weekday.between("1", "7") & (week > "00") & (F.year(F.date_from_unix_date(thursday.cast("int"))) == year.cast("int"))
    date = F.when(week == "", days(month, day)).when(real, thursday - 4 + weekday.cast("long"))
    digits = F.rpad(F.regexp_replace(F.substr(zone, F.lit(2)), ":", ""), 6, "0")
    offset = sum(F.substring(digits, i, 2).cast("long") * n for i, n in ((1, 3600), (3, 60), (5, 1)))
    whole = (F.substring(digits, 1, 2) < "24") & (F.substring(digits, 3, 2) < "60") & (F.substring(digits, 5, 2) < "60")
    offset = F.when(zone.isin("", "Z"), F.lit(0).cast("long")).when(whole, F.when(F.substring(zone, 1, 1) == "-", -offset).otherwise(offset))
    at = hour.cast("long") * 3600 + minute.cast("long") * 60 + second.cast("long")
    return F.when((hour < "24") & (minute < "60") & (second < "60"), date * 86400 + at - offset)


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 date or date and time, extended or compact, by month or week; UTC if it names no zone, whatever the session's is. Null if none."""
    def parse(pattern: str, date, at: Column) -> Column:
        part = lambda k, none="": F.coalesce(F.nullif(F.regexp_extract(at, pattern, k), F.lit("")), F.lit(none))
        return F.when(at.rlike(pattern), _let([*date(part), part(5, "00"), part(7, "00"), part(8, "00"), part(9)], _seconds_of))

    by_month = lambda part: [part(1), part(3), part(4), F.lit(""), F.lit("")]
    by_week = lambda part: [part(1), F.lit(""), F.lit(""), part(3), part(4, "1")]
    return _let([text], lambda at: F.coalesce(parse(_DATE_TIME, by_month, at), parse(_WEEK_TIME, by_week, at)))


def canonical_timestamp(c: Column, now: Column | int) -> Column:
    """Epoch seconds, floored, of a number or an ISO-8601 text (UTC if it names no zone); null if neither or beyond now."""
    text = F.btrim(c.cast("string"), F.lit(_BLANKS))
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.2e18)
    ts = F.when(finite, F.floor(F.when(finite, number)).cast("long")).when(number.isNull(), iso_seconds(text))
    now = F.lit(now) if isinstance(now, int) else now
    return F.when(ts <= now + FUTURE_SECONDS, ts)


def canonical_merchant(c: Column) -> Column:
    """Normalized; null where it has more than MERCHANT_BYTES bytes."""
    n = normalize_string(c)
    return F.when(F.octet_length(n) <= MERCHANT_BYTES, n)


def valid_price(c: Column) -> Column:
    """A finite number above zero, else null."""
    p = F.btrim(c.cast("string"), F.lit(_BLANKS)).try_cast("double")
    return F.when(~F.isnan(p) & (p > 0) & (p < float("inf")), p)


@F.pandas_udf(T.StringType())
def _repr(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None or v != v else repr(float(v)) for v in s], dtype=object)


def canonical_number(c: Column) -> Column:
    """Shortest text of a double: integers below 2**53 without a point. Only texts with an exponent need Python's."""
    x = c.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < float(1 << 53))
    text = x.cast("string")
    odd = text.contains("E")
    return F.when(whole, x.cast("decimal(20,0)").cast("string")).when(odd, _repr(F.when(odd & ~whole, x))).otherwise(text)


def canonical_string(c: Column) -> Column:
    """A JSON string; other than ASCII stays as it is."""
    s = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    control = s.rlike(r"[\x00-\x1F]")
    escaped = s
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(named.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(control, escaped).otherwise(s), F.lit('"'))


def canonical_json(fields: dict[str, Column | dict]) -> Column:
    """An object with its keys sorted and no white space; values are JSON already."""
    parts: list[Column] = [F.lit("{")]
    for i, k in enumerate(sorted(fields)):
        v = fields[k]
        parts += [F.lit(("," if i else "") + f'"{k}":'), canonical_json(v) if isinstance(v, dict) else v]
    return F.concat(*parts, F.lit("}"))


def evidence_hash(pil: str = "pil") -> Column:
    """SHA-256 of the canonical JSON of a normalized observation's columns."""
    s = canonical_string
    return F.sha2(
        canonical_json(
            {
                **{k: s(F.col(k)) for k in ("currency", "domain_id", "merchant_id", "region")},
                "price": canonical_number(F.col("price")),
                "timestamp": F.col("timestamp").cast("string"),
                "product_identity_layer": {f: s(F.col(f"{pil}.{f}")) for f in PIL_FIELDS},
            }
        ),
        256,
    )


def hash_unit(c: Column) -> Column:
    """The first 64 bits of SHA-256 as a share of the greatest; 0 for the empty text."""
    first = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return F.when(c == "", F.lit(0.0)).otherwise(first / F.lit(18446744073709551615.0))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def round6(c: Column) -> Column:
    return F.bround(c, 6)


def at_least(c: Column, threshold: Column | float) -> Column:
    return c + GATE_TOLERANCE >= threshold
