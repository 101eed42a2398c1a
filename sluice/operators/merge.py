"""Merges of jobs: groups, winners, their values, redirects, postings and saved jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import resolve

#: What the winner takes from the richest posting. Its hash and what the hash is made of stay: new postings meet it by them.
SHOWN = ("title", "company_name", "location", "workplace_type", "employment_type", "language", "description", "technologies", "posted_at")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node that it is connected with, of edges (a, b). Loops make a component of one.

    By contraction: in each round every node joins the neighbour, or itself,
    that comes first in an order drawn anew for the round, so that a fair part
    of the nodes goes whatever the shape of the graph; the rounds are some
    log(nodes). Rounds are tables; nothing is gathered in one task, and a
    node's neighbours are aggregated before they are shuffled.
    """
    rest = settled(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    labels = settled(labels, "labels")
    k = 0
    while rest.limit(1).count():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("to"))  # noqa: B023, E731
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(rest.select(F.col("b").alias("v"), F.col("a").alias("w")))
        first = both.groupBy("v").agg(F.min(drawn(F.col("w"))).alias("f")).select("v", F.least(F.col("f"), drawn(F.col("v")))["to"].alias("to"))
        first = settled(first, "contracted")
        to = lambda c: first.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        labels = settled(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")), "labels")
        rest = settled(rest.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        k += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


@dataclass
class Merged:
    jobs: DataFrame
    postings: DataFrame
    saved: DataFrame
    groups: DataFrame


def merge_groups(jobs: DataFrame, merges: DataFrame) -> DataFrame:
    """job_id and winner of all jobs that merges (job_a, job_b) bring together, and of those that were merged into one of them before.

    A merge of a job that was merged already is one of the job that it leads
    to. Merges of unknown jobs, and of a job with itself, bring nothing. In a
    group the job that was seen first wins, then the least id.
    """
    ends = settled(resolve.resolve_chains(jobs.select("job_id", "merged_into"), hops=10, cycle_to_repeat=True), "ends")
    end = lambda c: ends.select(F.col("job_id").alias(c), F.col("canonical_id").alias(c[-1]))
    edges = merges.select("job_a", "job_b").join(end("job_a"), "job_a").join(end("job_b"), "job_b").filter("a <> b")
    groups = components(edges.select("a", "b"))
    members = groups.select(F.col("node").alias("job_id"), "component").join(jobs.select("job_id", "first_seen_at"), "job_id")
    best = members.groupBy("component").agg(F.min(F.struct("first_seen_at", "job_id")).alias("w")).select("component", F.col("w.job_id").alias("winner"))
    won = groups.join(best, "component").select(F.col("node").alias("canonical_id"), "winner")
    return ends.join(won, "canonical_id").select("job_id", "winner")


def merge_jobs(jobs: DataFrame, postings: DataFrame, saved: DataFrame, merges: DataFrame) -> Merged:
    """Snapshots of jobs, postings and saved after merges (job_a, job_b): merge_groups and merged. Empty tables give empty ones."""
    return merged(jobs, postings, saved, settled(merge_groups(jobs, merges), "groups"))


def merged(jobs: DataFrame, postings: DataFrame, saved: DataFrame, groups: DataFrame) -> Merged:
    """Snapshots of jobs, postings (source_id, external_id, job_id, ...) and saved (user_id, job_id, saved_at) after groups (job_id, winner) became one each.

    The winner of a group takes SHOWN from the richest of all the group's
    postings (the longest description, then the least key), has been seen from
    the first to the last time that any of them was, and is active if one is.
    The others are redirected straight to it, as are jobs that were merged into
    them before. Postings and saved jobs follow; of what a user saved twice the
    newest date stays. All else is as it was.
    """
    moved = postings.join(groups, "job_id").withColumn("job_id", F.col("winner"))
    shown = [c for c in SHOWN if c in postings.columns and c in jobs.columns]
    place = F.struct(-F.length(F.coalesce("description", F.lit(""))), "source_id", "external_id")
    rich = moved.groupBy(F.col("winner").alias("job_id")).agg(F.min_by(F.struct(*shown), place).alias("rich"))
    whole = jobs.join(groups, "job_id").groupBy(F.col("winner").alias("job_id")).agg(F.min("first_seen_at").alias("from"), F.max("last_seen_at").alias("to"), F.max("is_active").alias("any_active"))
    facts = whole.join(rich, "job_id", "left")
    wide = jobs.join(groups, "job_id", "left").join(facts, "job_id", "left")
    wins = F.col("winner") == F.col("job_id")
    values: dict[str, Column] = {c: F.when(wins & F.col("rich").isNotNull(), F.col(f"rich.{c}")).otherwise(F.col(c)) for c in shown}
    values["merged_into"] = F.when(wins, F.lit(None)).otherwise(F.coalesce("winner", "merged_into"))
    values |= {c: F.when(wins, F.col(x)).otherwise(F.col(c)) for c, x in (("first_seen_at", "from"), ("last_seen_at", "to"), ("is_active", "any_active"))}
    if "effective_posted_at" in jobs.columns and "posted_at" in shown:
        values["effective_posted_at"] = F.when(wins, F.coalesce("rich.posted_at", "effective_posted_at")).otherwise(F.col("effective_posted_at"))
    new_jobs = wide.select(*[values.get(c, F.col(c)).alias(c) for c in jobs.columns])
    to = groups.select("job_id", "winner")
    new_postings = postings.join(to, "job_id", "left").withColumn("job_id", F.coalesce("winner", "job_id")).select(*postings.columns)
    followed = saved.join(to, "job_id", "left").groupBy("user_id", F.coalesce("winner", "job_id").alias("job_id")).agg(F.max("saved_at").alias("saved_at"))
    return Merged(new_jobs, new_postings, followed.select(*saved.columns), groups)
