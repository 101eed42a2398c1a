"""From raw documents to postings and jobs: one batch, as snapshots or into stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..storage import SnapshotTable, settled
from . import merge, resolve, write
from .similar import TitleIndex

KEYS = ["source_id", "external_id"]
PAYLOAD = "title string, company string, country string, location string, description string, workplaceType string, employmentType string, language string, postedAt string"
#: What a listing says, as postings and jobs have it.
CONTENT = (
    "title string, normalized_title string, company_name string, company_slug string, location string, country_code string, workplace_type string, "
    "employment_type string, language string, description string, technologies array<string>, posted_at timestamp_ntz"
)
POSTING = f"source_id string, external_id string, url string, {CONTENT}, content_hash string, dedup_hash string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_active boolean, job_id string"
JOB = (
    f"job_id string, {CONTENT}, dedup_hash string, merged_into string, effective_posted_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, is_active boolean, "
    "junior_level string, junior_score int, required_min_years int, required_max_years int, classified_at timestamp_ntz"
)


@dataclass
class Snapshots:
    postings: DataFrame
    jobs: DataFrame
    quarantine: DataFrame
    assigned: DataFrame


def latest_payloads(raw: DataFrame) -> DataFrame:
    """raw (source_id, external_id, content_hash, url, payload, fetched_at): of each (source_id, external_id) the newest; ties by content_hash."""
    newest = F.max_by(F.struct("url", "payload", "fetched_at"), F.struct("fetched_at", "content_hash"))
    return raw.groupBy(*KEYS).agg(newest.alias("x")).select(*KEYS, "x.*")


def candidates(raw: DataFrame) -> DataFrame:
    """The newest payloads as posting candidates: source_id, external_id, url, CONTENT, content_hash, dedup_hash, seen_at, ingest_pos.

    Malformed payloads give nulls, which resolve_batch puts into quarantine.
    Text functions run in Python here; resolve_batch writes the result down before it uses it.
    """
    # a number, for adaptive execution would make one task of few bytes, and texts take long; by the keys alone it would be left out, for they are grouped by
    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = latest_payloads(raw).repartition(n, F.xxhash64(*KEYS)).withColumn("p", F.from_json("payload", PAYLOAD))
    said = {c: text.plain_text(F.col(f"p.{c}")) for c in ("title", "company", "country", "location")}
    plain = p.withColumns(said | {"description": text.html_text(F.col("p.description")), "posted_at": F.try_to_timestamp("p.postedAt").cast("timestamp_ntz")})
    title, description = F.col("title"), F.col("description")
    named = plain.withColumns(
        {
            "company_slug": text.company_slug(F.col("company"), normalized=True),
            "normalized_title": text.normalized_title(title),
            "workplace_type": text.workplace_type(title, F.col("location"), description, F.col("p.workplaceType")),
            "employment_type": text.employment_type(title, description, F.col("p.employmentType")),
            "language": text.detect_language(title, description, F.col("p.language")),
            "technologies": text.technologies(title, description),
        }
    )
    content = hashing.posting_hash(*[F.col(c) for c in ("url", "title", "company", "company_slug", "location", "country", "workplace_type", "employment_type", "language", "description", "technologies", "posted_at")])
    code = F.nullif(F.upper(F.trim("country")), F.lit(""))
    return named.select(
        *KEYS, "url", "title", "normalized_title", F.col("company").alias("company_name"), "company_slug", "location", code.alias("country_code"), "workplace_type", "employment_type", "language", "description",
        "technologies", "posted_at", content.alias("content_hash"), hashing.dedup_hash(F.col("company_slug"), F.col("normalized_title"), F.col("country")).alias("dedup_hash"),
        F.col("fetched_at").alias("seen_at"), F.struct("fetched_at", *KEYS).alias("ingest_pos"),
    )


def usable(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with identity and title, and those for quarantine, from one table that is written once."""
    problem = write.posting_problem(*[F.col(c) for c in ("source_id", "external_id", "url", "title", "company_slug", "normalized_title")])
    return write.split_usable(settled(found, "candidates"), problem)


def placed_candidates(good: DataFrame, postings: DataFrame) -> DataFrame:
    """Candidates as postings without a job yet, or with the one that they have: posting_id is their key."""
    return good.join(postings.select(*KEYS, "job_id"), KEYS, "left").withColumn("posting_id", F.struct(*KEYS))


def resolve_batch(found: DataFrame, postings: DataFrame, jobs: DataFrame, now: Column, similar: DataFrame | None = None) -> Snapshots:
    """Snapshots of postings and jobs (as of write) after the candidates in found; those without identity or title are in quarantine.

    A posting keeps the job that it has; a new one joins the job of its hash,
    or else that which similar (posting_id, job_id) names, or else makes one. A
    job that was merged passes its postings on to the one that it leads to.
    """
    good, bad = usable(found)
    return _resolved(placed_candidates(good, postings), good, bad, postings, jobs, now, similar)


def _resolved(free: DataFrame, good: DataFrame, bad: DataFrame, postings: DataFrame, jobs: DataFrame, now: Column, similar: DataFrame | None, redirects: DataFrame | None = None) -> Snapshots:
    assigned = resolve.cluster(free, jobs, similar)
    if redirects is None and "merged_into" in jobs.columns:
        redirects = resolve.resolve_chains(jobs.select("job_id", "merged_into"), hops=10, cycle_to_repeat=True).filter("job_id <> canonical_id")
    if redirects is not None:
        led = redirects.select(F.col("job_id").alias("assigned_job_id"), "canonical_id")
        assigned = assigned.join(led, "assigned_job_id", "left").withColumn("assigned_job_id", F.coalesce("canonical_id", "assigned_job_id")).drop("canonical_id")
    assigned = settled(assigned, "assigned")
    seen = write.upsert_postings(postings, good)
    jobs_of = assigned.select(*KEYS, "assigned_job_id")
    placed = seen.join(jobs_of, KEYS, "left").withColumn("job_id", F.coalesce("assigned_job_id", "job_id")).select(*seen.columns)
    return Snapshots(placed, write.upsert_jobs(jobs, assigned, now), bad, assigned)


class JobStore:
    """Postings, jobs, and the titles that tier 3 asks, as stored tables. Job ids are those that cluster() makes.

    A batch reads and writes only the buckets of its own postings and of the
    jobs that these can join. Titles are stored first, then jobs, then postings:
    if a batch dies in between, it can be given again, for jobs without
    postings are matched by their hash, and titles without a job are passed by.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.postings, self.jobs, self.titles = SnapshotTable(spark, f"{root}/postings"), SnapshotTable(spark, f"{root}/jobs"), TitleIndex(spark, f"{root}/titles")

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 32, titles: DataFrame | None = None) -> JobStore:
        """Empty tables. titles: rows with normalized_title that tell which trigrams are rare."""
        SnapshotTable.create(spark, f"{root}/postings", spark.createDataFrame([], POSTING).schema, KEYS, buckets)
        SnapshotTable.create(spark, f"{root}/jobs", spark.createDataFrame([], JOB).schema, ["job_id"], buckets)
        TitleIndex.create(spark, f"{root}/titles", titles, buckets=buckets)
        return cls(spark, root)

    def similar(self, free: DataFrame, known: DataFrame) -> DataFrame:
        """posting_id and job_id of postings that have no job, whose hash is not known, and that are similar to a job that is there."""
        unknown = settled(free.filter("job_id IS NULL").join(known.select("dedup_hash"), "dedup_hash", "left_anti"), "unknown")
        best = settled(self.titles.best(unknown), "similar")
        there = self.jobs.read(only=self.jobs.touched(best)).select("job_id")
        return best.join(there, "job_id", "left_semi").select("posting_id", "job_id")

    def ingest(self, raw: DataFrame, now: Column) -> Snapshots:
        """Take in the newest payloads of raw documents (as of latest_payloads)."""
        good, bad = usable(candidates(raw))
        old = self.postings.read(only=self.postings.touched(good))
        free = settled(placed_candidates(good, old), "placed")
        by_hash = free.select(F.concat(F.lit("job-"), "dedup_hash").alias("job_id"))
        similar = settled(self.similar(free, self.jobs.read(only=self.jobs.touched(by_hash))), "similar")
        # redirects are few; all of them are read, two columns wide
        redirects = resolve.resolve_chains(self.jobs.read().select("job_id", "merged_into"), hops=10, cycle_to_repeat=True).filter("job_id <> canonical_id")
        redirects = settled(redirects, "redirects")
        ids = by_hash.unionByName(free.filter("job_id IS NOT NULL").select("job_id")).unionByName(similar.select("job_id"))
        ids = settled(ids.unionByName(ids.join(redirects, "job_id").select(F.col("canonical_id").alias("job_id"))).distinct(), "ids")
        jobs = self.jobs.read(only=self.jobs.touched(ids))
        out = _resolved(free, good, bad, old, jobs, now, similar, redirects)
        self.titles.add(out.assigned.filter("outcome = 'CREATED'").withColumn("job_id", F.col("assigned_job_id")))
        self.jobs.rewrite(ids, lambda _: out.jobs)
        self.postings.rewrite(good, lambda _: out.postings)
        return out

    def merge(self, merges: DataFrame) -> DataFrame:
        """Merge jobs (job_a, job_b); returns job_id and winner of all that changed.

        Jobs are read three columns wide to find the groups, postings one wide
        to find theirs; buckets with neither stay. Postings are written first:
        if the merge dies before the jobs are, it can be given again.
        """
        facts = self.jobs.read().select("job_id", "merged_into", "first_seen_at")
        groups = settled(merge.merge_groups(facts, merges), "groups")
        moved = settled(self.postings.read().join(groups, "job_id", "left_semi").select(*KEYS), "moved")
        jobs, postings = self.jobs.read(only=self.jobs.touched(groups)), self.postings.read(only=self.postings.touched(moved))
        saved = self.spark.createDataFrame([], "user_id string, job_id string, saved_at timestamp_ntz")
        made = merge.merged(jobs, postings, saved, groups)
        new_jobs = settled(made.jobs, "merged")  # from the postings as they are now
        self.postings.rewrite(moved, lambda _: made.postings)
        self.jobs.rewrite(groups, lambda _: new_jobs)
        return groups
