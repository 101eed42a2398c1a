"""Content and identity hashes."""

from __future__ import annotations

import datetime
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_millis(ts: Column) -> Column:
    """UTC with milliseconds and Z; the session's time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_field(x: Column) -> Column:
    """One string as JSON text; null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(x)), "(?s)\\A\\[(.*)\\]\\z", 1), F.lit("null"))


def posting_hash(url, title, company, slug, location, country, workplace, employment, language, description, technologies, posted_at) -> Column:
    """SHA-256 over twelve JSON-encoded fields joined by NUL; technologies count as a set."""
    fields = [url, title, company, slug, location, country, workplace, employment, language, description]
    parts = [json_field(c) for c in fields] + [json_field(F.array_join(F.sort_array(technologies), ",")), json_field(iso_millis(posted_at))]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def dedup_hash(slug: Column, title: Column, country: Column) -> Column:
    """SHA-256 over slug|title|COUNTRY; null and empty country are the same."""
    return F.sha2(F.concat_ws("|", slug, title, F.upper(F.trim(F.coalesce(country, F.lit(""))))), 256)


def number_text(x: float) -> str:
    """A number as JSON.stringify writes it."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    s, point = "".join(map(str, digits)), len(digits) + exponent
    if len(s) <= point <= 21:
        out = s + "0" * (point - len(s))
    elif 0 < point <= 21:
        out = f"{s[:point]}.{s[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{s}"
    else:
        e = point - 1
        out = (s if len(s) == 1 else f"{s[0]}.{s[1:]}") + f"e{'+' if e >= 0 else '-'}{abs(e)}"
    return "-" * sign + out


def strip_paths(value, paths: list[list[str]]):
    """value without the given paths; arrays on the way are looked through."""
    if isinstance(value, list):
        return [strip_paths(v, paths) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, v in value.items():
        below = [p[1:] for p in paths if p[0] == key]
        if [] not in below:
            out[key] = strip_paths(v, below) if below else v
    return out


def canonical(value) -> str:
    """JSON with keys in UTF-16 order at every depth and no blanks."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return json.dumps(value.isoformat())
    return json.dumps(value, ensure_ascii=False)


def canonical_json(payload: Column, volatile_paths: tuple[str, ...] = ()) -> Column:
    """Canonical form of JSON text without volatile paths; null for null and malformed text."""
    paths = [[s for s in p.split(".") if s] for p in volatile_paths]
    paths = [p for p in paths if p]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else canonical(strip_paths(json.loads(text), paths))
            except ValueError:
                return None

        return s.map(one)

    return run(payload)


def payload_hash(payload: Column, volatile_paths: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical_json(payload, volatile_paths), 256)
