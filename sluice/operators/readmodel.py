"""Read model: listing, detail, facets, ranking, saved jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Page:
    items: DataFrame
    page: int
    page_size: int
    total: int


def check_page(page: int = 1, page_size: int = 20) -> tuple[int, int]:
    for name, value, most in (("page", page, None), ("page_size", page_size, 50)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1 or (most and value > most):
            raise ValueError(f"{name} must be a whole number from 1 on" + (f" to {most}" if most else ""))
    return page, page_size


def listable(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("is_active") & F.col("merged_into").isNull())


def searchable(jobs: DataFrame, now: Column, days: int = 45) -> DataFrame:
    """Listable jobs that were seen in the last `days`; older ones are kept, for those who saved them."""
    return listable(jobs).filter(F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(days)))


def page_of(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a total order."""
    page, page_size = check_page(page, page_size)
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def list_jobs(jobs: DataFrame, page: int = 1, page_size: int = 20) -> Page:
    rows = listable(jobs)
    return Page(page_of(rows, [F.desc_nulls_last("effective_posted_at"), F.desc_nulls_last("id")], page, page_size), page, page_size, rows.count())


def source_counts(postings: DataFrame, key: str, source: str) -> DataFrame:
    return postings.groupBy(key).agg(F.countDistinct(source).alias("source_count"))


#: What a list shows of a job; the description is left out, so that it is not read.
SUMMARY = ("id", "title", "company_name", "location", "country_code", "workplace_type", "employment_type", "language", "technologies", "posted_at", "effective_posted_at", "junior_level", "junior_score", "required_min_years", "required_max_years")


def summaries(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """SUMMARY of jobs and source_count, how many sources list each (0 for none)."""
    counts = source_counts(postings, "job_id", "source_id").withColumnRenamed("job_id", "id")
    return jobs.select(*SUMMARY).join(counts, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def nested(rows: DataFrame, key: str, fields: list[Column], name: str) -> DataFrame:
    """Each key with its rows as a sorted array of structs."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def facets(jobs: DataFrame, now: Column, technologies: list[str] = (), locations: list[str] = (), country: str | None = None, workplace: list[str] = (), employment: list[str] = (), levels: list[str] = (), min_score: int | None = None, max_years: int | None = None, posted_within_days: int | None = None, include_experienced: bool = False) -> DataFrame:
    """Filters of the search. Unclassified jobs stay; a job without required years passes max_years."""
    out = jobs
    hidden = ["CLEARLY_EXPERIENCED"] if include_experienced else ["CLEARLY_EXPERIENCED", "EXPERIENCED"]
    out = out.filter(F.col("junior_level").isNull() | ~F.col("junior_level").isin(hidden))
    if technologies:
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, technologies)), F.col("technologies"))) == 0)
    for column, wanted in (("location", locations), ("workplace_type", workplace), ("employment_type", employment), ("junior_level", levels), ("country_code", [country] if country else [])):
        if wanted:
            out = out.filter(F.col(column).isin(list(wanted)))
    if min_score is not None:
        out = out.filter(F.col("junior_score") >= min_score)
    if max_years is not None:
        out = out.filter(F.col("required_min_years").isNull() | (F.col("required_min_years") <= max_years))
    if posted_within_days is not None:
        out = out.filter(F.col("effective_posted_at") >= now - F.make_dt_interval(F.lit(posted_within_days)))
    return out


def sort_order(by: str) -> list[Column]:
    """A total order for relevance, juniorScore or postedAt, nulls last."""
    column = {"relevance": "relevance", "juniorScore": "junior_score", "postedAt": "effective_posted_at"}.get(by)
    if column is None:
        raise ValueError(f"cannot sort by {by!r}")
    return [F.desc_nulls_last(column), F.desc_nulls_last("id")]


def job_by_id(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.filter(F.col("id") == F.lit(job_id))


def job_detail(jobs: DataFrame, postings: DataFrame, sources: DataFrame, history: DataFrame) -> DataFrame:
    """Jobs (id, ...) with sources, the array of their postings' (name, url) in that order, and their current classification."""
    where = postings.join(sources, "source_id").select(F.col("job_id").alias("id"), F.struct("name", "url").alias("s"))
    listed = where.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
    current = history.filter("is_current").select(F.col("job_id").alias("id"), F.struct("level", "score").alias("classification"))
    return jobs.join(listed, "id", "left").join(current, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<name:string,url:string>>")))


#: Our choice: shares of text rank, junior score, recency and profile fit.
RELEVANCE = (0.4, 0.3, 0.2, 0.1)


def relevance(text_rank: Column, junior_score: Column, age_days: Column, fit: Column) -> Column:
    """Blend of four parts from 0 to 1; recency halves every 30 days."""
    parts = (text_rank, F.coalesce(junior_score, F.lit(0)) / 100, F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / 30), fit)
    return sum((F.lit(w) * F.coalesce(p, F.lit(0.0)) for w, p in zip(RELEVANCE, parts, strict=True)), F.lit(0.0))


def profile_fit(technologies: Column, wanted: Column) -> Column:
    """Share of wanted technologies that are there."""
    return F.coalesce(F.size(F.array_intersect(technologies, wanted)) / F.nullif(F.size(wanted), F.lit(0)), F.lit(0.0))


def save_jobs(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """saved and wanted (user_id, job_id, saved_at); a job that is saved keeps its row."""
    return saved.unionByName(wanted.groupBy("user_id", "job_id").agg(F.min("saved_at").alias("saved_at")).join(saved, ["user_id", "job_id"], "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], never: tuple[str, ...] = ()) -> DataFrame:
    """A new snapshot: incoming rows replace those with equal keys, but for columns in `never`."""
    columns = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*columns).alias("old"))
    b = incoming.select(*keys, F.struct(*[c for c in columns if c in incoming.columns]).alias("new"))
    joined = a.join(b, keys, "full_outer")
    pick = lambda c: F.col(f"old.{c}") if c not in incoming.columns else F.coalesce(f"old.{c}", f"new.{c}") if c in never else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in columns])
