"""Experience, signals, level and score of a job's text. The score is no probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence, phrase_pattern

YEARS = "(?:years?|yrs?|jahren?)"
RANGE = f"(\\d{{1,2}}) ?(?:-|–|to|bis) ?(\\d{{1,2}})\\+? {YEARS}"
LEAST = f"(?:(?:at least|min\\.?|minimum|mindestens|ab) (\\d{{1,2}})|(\\d{{1,2}}) ?\\+) ?{YEARS}"

#: Our choice of phrases and weights; the level's bands are below.
POSITIVE = {"entry_level": ("entry level", 20), "graduates": ("recent graduates", 20), "no_experience": ("no experience required", 25), "training": ("training provided", 10), "career_starter": ("career starter", 20), "berufseinsteiger": ("berufseinsteiger", 20)}
NEGATIVE = {"senior_tasks": ("senior responsibilities", -20), "lead_team": ("lead a team", -20), "management": ("team management", -15), "production": ("extensive production experience", -15)}
BANDS = {"ENTRY_LEVEL": (85, 100), "LIKELY_ENTRY_LEVEL": (65, 84), "AMBIGUOUS": (40, 64), "EXPERIENCED": (15, 39), "CLEARLY_EXPERIENCED": (0, 14)}


def required_years(text: Column) -> Column:
    """struct(min_years, max_years) of the highest requirement that is named; nulls if none is."""
    t = F.lower(text)
    ranges = F.transform(F.regexp_extract_all(t, F.lit(RANGE), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, RANGE, 1).cast("int").alias("min_years"), F.regexp_extract(m, RANGE, 2).cast("int").alias("max_years")))
    least = F.transform(F.regexp_extract_all(t, F.lit(LEAST), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, "(\\d{1,2})", 1).cast("int").alias("min_years"), F.lit(None).cast("int").alias("max_years")))
    return F.array_max(F.concat(ranges, least))


def signals(text: Column, phrases: dict[str, tuple[str, int]]) -> Column:
    """Sorted array of struct(code, weight, evidence): phrases that the text says as whole words and does not negate just
    before; evidence is the text's own spelling. Null says nothing."""
    weights = F.create_map(*[F.lit(v) for code, (_, weight) in sorted(phrases.items()) for v in (code, weight)])
    found = evidence(text, {code: phrase_pattern([p]) for code, (p, _) in phrases.items()})
    return F.transform(found, lambda x: F.struct(x["name"].alias("code"), F.element_at(weights, x["name"]).alias("weight"), x["evidence"].alias("evidence")))


def parse_signals(json: Column) -> Column:
    """Entries of a JSON array that have code (string), weight (number) and evidence (string), in order; others are dropped."""
    entries = F.coalesce(F.from_json(json, "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda v, k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    number = lambda v: kind(v, "weight").rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT)$")
    good = F.filter(entries, lambda v: F.coalesce((kind(v, "code") == "STRING") & number(v) & (kind(v, "evidence") == "STRING"), F.lit(False)))
    return F.transform(good, lambda v: F.struct(F.try_variant_get(v, "$.code", "string").alias("code"), F.try_variant_get(v, "$.weight", "double").alias("weight"), F.try_variant_get(v, "$.evidence", "string").alias("evidence")))


def level(title: Column, min_years: Column, positive: Column, negative: Column) -> Column:
    """Numbers beat phrases, phrases beat the title; a title alone gives no more than a likelihood."""
    junior, senior = F.lower(title).rlike("(?<![a-z])(junior|jr|graduate|trainee)(?![a-z])"), F.lower(title).rlike("(?<![a-z])(senior|lead|principal|staff)(?![a-z])")
    p, n = F.size(positive), F.size(negative)
    return (
        F.when((min_years >= 5) & (n > 0), "CLEARLY_EXPERIENCED").when(min_years >= 3, "EXPERIENCED").when(min_years == 2, "AMBIGUOUS").when(min_years == 1, "LIKELY_ENTRY_LEVEL").when(min_years == 0, "ENTRY_LEVEL")
        .when((p > 0) & (n == 0), F.when(junior, "ENTRY_LEVEL").otherwise("LIKELY_ENTRY_LEVEL")).when((n > 0) & (p == 0), F.when(senior, "CLEARLY_EXPERIENCED").otherwise("EXPERIENCED"))
        .when(junior & (p == n), "LIKELY_ENTRY_LEVEL").when(senior & (p == n), "EXPERIENCED").otherwise("AMBIGUOUS")
    )


def score(level_col: Column, weight: Column) -> Column:
    """0 to 100: the middle of the level's band, moved by the signals' weights within the band."""
    out = F.lit(None).cast("int")
    for name, (lo, hi) in BANDS.items():
        out = F.when(level_col == name, F.least(F.lit(hi), F.greatest(F.lit(lo), F.round((lo + hi) / 2 + weight / 4).cast("int")))).otherwise(out)
    return out


def current_only(history: DataFrame) -> DataFrame:
    """history (job_id, version, input_hash, created_at) with is_current true for the newest row of each job."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("version"), F.desc("input_hash")))
    return history.withColumn("is_current", n == 1)


def to_classify(jobs: DataFrame, history: DataFrame, version: str) -> DataFrame:
    """Jobs (job_id, input_hash) that have no result of this version for their text."""
    return jobs.join(history.filter(F.col("version") == version), ["job_id", "input_hash"], "left_anti")
