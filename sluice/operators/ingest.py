"""Raw layer: item checks, append of what is new, run ledger, retention. `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MESSAGE = "stale run: no heartbeat before the cutoff"


def item_problem(external_id: Column, url: Column, payload: Column) -> Column:
    """Why an item cannot be stored, or null."""
    return F.when(F.coalesce(external_id, F.lit("")) == "", "id").when(~F.coalesce(url, F.lit("")).startswith("https://"), "url").when(payload.isNull(), "payload")


def new_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming whose (source_id, external_id, content_hash) is not stored; of repeated ones the first by ingest_pos."""
    keys = ["source_id", "external_id", "content_hash"]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in keys]), "ingest_pos").alias("x"))
    return first.join(existing.select(*keys), keys, "left_anti").select(*keys, "x.*")


def run_counters(items: DataFrame) -> DataFrame:
    """items (run_id, outcome in stored, unchanged, failed) to fetched, unchanged, failed, stored of each run."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return items.groupBy("run_id").agg(F.count("*").alias("fetched"), n("unchanged"), n("failed")).withColumn("stored", F.col("fetched") - F.col("unchanged") - F.col("failed"))


def may_open_run(runs: DataFrame, source_id: str) -> bool:
    return runs.filter((F.col("source_id") == source_id) & (F.col("status") == "RUNNING")).limit(1).count() == 0


def reap(runs: DataFrame, now: Column, source_id: str | None = None) -> DataFrame:
    """runs with those that are RUNNING and began more than an hour ago as FAILED; adds reaped."""
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr("INTERVAL 1 HOUR"))
    if source_id is not None:
        stale = stale & (F.col("source_id") == source_id)
    stale = F.coalesce(stale, F.lit(False))
    return runs.withColumn("reaped", stale).withColumns({"status": F.when(F.col("reaped"), "FAILED").otherwise(F.col("status")), "finished_at": F.when(F.col("reaped"), now).otherwise(F.col("finished_at")), "error_message": F.when(F.col("reaped"), STALE_MESSAGE).otherwise(F.col("error_message"))})


def sync_sources(existing: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Upsert by key; whether a source is enabled is never overwritten, and true for new ones."""
    new = descriptors.select("key", *[F.col(c).alias(f"__{c}") for c in descriptors.columns if c != "key"])
    other = [c for c in descriptors.columns if c not in ("key", "enabled")]
    joined = existing.join(new, "key", "full_outer")
    return joined.select("key", *[F.coalesce(f"__{c}", c).alias(c) for c in other], F.coalesce("enabled", F.lit(True)).alias("enabled"))


def retained(documents: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return documents.filter(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days)))


def job_activity(postings: DataFrame) -> DataFrame:
    """job_id, is_active: a job is active while one of its postings is."""
    return postings.groupBy("job_id").agg(F.bool_or(F.coalesce("is_active", F.lit(False))).alias("is_active"))


def unseen_postings(postings: DataFrame, runs: DataFrame, misses: int = 2) -> DataFrame:
    """postings with is_active false where the last `misses` successful runs of the source began after last_seen_at."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("started_at").desc()))
    cut = runs.filter(F.col("status") == "SUCCESS").withColumn("r", rank).filter(F.col("r") == misses).select("source_id", F.col("started_at").alias("__cut"))
    gone = F.coalesce(F.col("last_seen_at") < F.col("__cut"), F.lit(False))
    return postings.join(cut, "source_id", "left").withColumn("is_active", F.col("is_active") & ~gone).drop("__cut")


def since_floor(runs: DataFrame, overlap: str = "INTERVAL 1 DAY") -> DataFrame:
    """source_id, since: start of the last successful run less an overlap."""
    return runs.filter(F.col("status") == "SUCCESS").groupBy("source_id").agg((F.max("started_at") - F.expr(overlap)).alias("since"))


def ingestion_plan(sources: DataFrame, runs: DataFrame, overlap: str = "INTERVAL 1 DAY") -> DataFrame:
    """source_id, since, item_limit of what is to be scanned now: enabled sources (source_id, enabled, page_size, max_pages) with
    no run in flight; since is null for one that never succeeded."""
    busy = runs.filter(F.col("status") == "RUNNING").select("source_id").distinct()
    free = sources.filter("enabled").join(busy, "source_id", "left_anti")
    return free.join(since_floor(runs, overlap), "source_id", "left").select("source_id", "since", (F.col("page_size") * F.col("max_pages")).cast("bigint").alias("item_limit"))


# --- scan semantics over a positioned table --------------------------------


def scan(items: DataFrame, pos: str, posted_at: str, since: Column | None = None, recent_first: bool = False, limit: int | None = None, page_size: int | None = None, max_pages: int | None = None, source: str | None = None) -> DataFrame:
    """What a paginated scan yields: page cap, then since (stop at the first older item, or skip older ones), then limit.

    Null dates pass, as do equal ones. With `source` each source is a scan of
    its own and runs in parallel. The stop position and the limit are found by
    aggregation and top-k, not by a window over the whole table.
    """
    by = [source] if source else []
    out = items
    if page_size is not None and max_pages is not None:
        out = out.filter(F.col(pos) < page_size * max_pages)
    if since is not None:
        old = F.col(posted_at) < since
        if recent_first:
            stop = out.filter(old).groupBy(*by).agg(F.min(pos).alias("__stop"))
            out = (out.join(stop, by, "left") if by else out.join(F.broadcast(stop.agg(F.min("__stop").alias("__stop"))))).filter(F.col("__stop").isNull() | (F.col(pos) < F.col("__stop"))).drop("__stop")
        else:
            out = out.filter(F.col(posted_at).isNull() | ~old)
    if limit is not None:
        if by:
            out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).filter(F.col("__n") <= max(limit, 0)).drop("__n")
        else:
            out = out.orderBy(pos).limit(max(limit, 0))
    return out
