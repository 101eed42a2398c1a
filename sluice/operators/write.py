"""The write side as snapshots: postings, jobs, runs and merges. `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_error, trim_space
from . import resolve

NEVER_SHOWN = ("password_hash", "token_hash")


def posting_problem(source_id: Column, external_id: Column, url: Column, title: Column, slug: Column, normalized_title: Column) -> Column:
    """Why a posting cannot be identified or hashed, or null: the name of the first empty field, or empty_title."""
    named = {"source_id": source_id, "external_id": external_id, "url": url, "title": title, "company_slug": slug}
    empty = [F.when(F.coalesce(trim_space(c.cast("string")), F.lit("")) == "", k) for k, c in named.items()]
    return F.coalesce(*empty, F.when(F.coalesce(normalized_title, F.lit("")) == "", "empty_title"))


def split_usable(postings: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Postings without a problem, and those for quarantine with it."""
    marked = postings.withColumn("problem", problem)
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


#: What a posting has besides its content: who it is, when it was seen, and its job.
POSTING_KEYS, POSTING_STATE = ("source_id", "external_id"), ("first_seen_at", "last_seen_at", "is_active", "job_id")


def upsert_postings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new snapshot of postings (source_id, external_id, their content, first_seen_at, last_seen_at, is_active, job_id)
    after incoming (source_id, external_id, their content, seen_at, ingest_pos).

    The content is whatever other columns existing has; what incoming has
    besides is left out. The last incoming row of a key by ingest_pos decides
    it. A posting that is seen is active, keeps its job and its first sight; one
    that is not stays as it is.
    """
    keys = list(POSTING_KEYS)
    content = [c for c in existing.columns if c not in (*POSTING_KEYS, *POSTING_STATE)]
    seen = incoming.groupBy(*keys).agg(F.max_by(F.struct(*content), "ingest_pos").alias("new"), F.min("seen_at").alias("from"), F.max("seen_at").alias("to"))
    both = existing.join(seen, keys, "full_outer")
    is_seen = F.col("new").isNotNull()
    return both.select(
        *keys,
        *[F.when(is_seen, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in content],
        F.coalesce("first_seen_at", "from").alias("first_seen_at"),
        F.when(is_seen, F.greatest("last_seen_at", "to")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (is_seen | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        "job_id",
    )


def upsert_jobs(jobs: DataFrame, assigned: DataFrame, now: Column) -> DataFrame:
    """A new snapshot of jobs after postings were assigned to them (as by resolve.cluster).

    A hash that no job has makes one, from its first posting by ingest_pos,
    with all columns that jobs and the posting share: it was posted at
    posted_at or else now, and is neither classified nor merged. Jobs that are
    matched are seen now and active; their own fields stay.
    """
    given = {"job_id": F.col("assigned_job_id"), "effective_posted_at": F.coalesce("posted_at", now), "first_seen_at": now, "last_seen_at": now, "is_active": F.lit(True)}
    value = lambda f: given.get(f.name, F.col(f"`{f.name}`") if f.name in assigned.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    made = assigned.filter(F.col("outcome") == "CREATED").select(*[value(f) for f in jobs.schema])
    touched = assigned.filter(F.col("outcome") != "CREATED").groupBy(F.col("assigned_job_id").alias("job_id")).agg(F.lit(True).alias("seen"))
    kept = jobs.join(touched, "job_id", "left").withColumns({"last_seen_at": F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")), "is_active": F.coalesce("seen", "is_active")})
    return kept.select(*jobs.columns).unionByName(made)


def in_flight(runs: DataFrame) -> DataFrame:
    """source_id, n: runs that have not ended."""
    return runs.filter(F.col("status") == "RUNNING").groupBy("source_id").agg(F.count("*").alias("n"))


def open_runs(runs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """New runs (run_id, source_id, status, started_at): one for each enabled source that has none in flight."""
    free = sources.filter("enabled").select("source_id").join(in_flight(runs), "source_id", "left_anti")
    return free.select(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), now.cast("string")), 256).alias("run_id"), "source_id", F.lit("RUNNING").alias("status"), now.alias("started_at"))


def close_runs(runs: DataFrame, counters: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Runs in flight with their counters (run_id, fetched, unchanged, failed, stored), ended: FAILED if errors (run_id, error) has them."""
    ended = runs.filter(F.col("status") == "RUNNING").join(counters, "run_id", "left").join(errors, "run_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fetched", "unchanged", "failed", "stored")]
    return ended.select("run_id", "source_id", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), now.alias("finished_at"), *counts, short_error(F.col("error")).alias("error_message"))


def redirect(jobs: DataFrame, merges: DataFrame) -> DataFrame:
    """jobs (job_id, merged_into, ref) after merges (ref, into_ref): refs are resolved to ids once all jobs are there.

    A merge into itself or into a ref that no job has changes nothing.
    """
    ids = jobs.select(F.col("ref").alias("into_ref"), F.col("job_id").alias("__into"))
    target = merges.filter("ref <> into_ref").join(ids, "into_ref").groupBy("ref").agg(F.min("__into").alias("__into"))
    return jobs.join(target, "ref", "left").withColumn("merged_into", F.coalesce("__into", "merged_into")).drop("__into")


def saved_listing(saved: DataFrame, jobs: DataFrame) -> DataFrame:
    """user_id, job_id, saved_at of saved jobs, each under the job that it was merged into; of several the newest date."""
    resolved = resolve.resolve_chains(jobs).filter(F.col("canonical_id").isNotNull())
    return saved.join(resolved, "job_id").groupBy("user_id", F.col("canonical_id").alias("job_id")).agg(F.max("saved_at").alias("saved_at"))


def unsave(saved: DataFrame, unwanted: DataFrame) -> DataFrame:
    return saved.join(unwanted.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def shown(rows: DataFrame) -> DataFrame:
    """Rows without what is never shown."""
    return rows.drop(*NEVER_SHOWN)


def live_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that have not expired: one that expires now has."""
    return tokens.filter(F.col("expires_at") > now)


def purged_tokens(tokens: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Tokens without those that expired more than `days` ago."""
    return tokens.filter(F.col("expires_at") >= now - F.make_dt_interval(F.lit(days)))


def with_default(rows: DataFrame, found: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Each key of rows with the columns of found, or their defaults where it has none."""
    return rows.join(found, key, "left").select(*[c for c in rows.columns], *[F.coalesce(c, v).alias(c) for c, v in defaults.items()])
