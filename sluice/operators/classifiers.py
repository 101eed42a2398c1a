"""Classifiers: what one has to offer, the one made of rules, and results that are kept."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import classify

#: Results, newest or not: which version said what of which text.
RESULT = "job_id string, version string, input_hash string, created_at timestamp_ntz, level string, score int, min_years int, max_years int, positive array<struct<code:string,weight:int,evidence:string>>, negative array<struct<code:string,weight:int,evidence:string>>"
#: The block that jobs have of their current result.
BLOCK = {"junior_level": "level", "junior_score": "score", "required_min_years": "min_years", "required_max_years": "max_years", "classified_at": "created_at"}


class Classifier(Protocol):
    """version names what decides; classify() gives job_id, level, score, min_years, max_years, positive and negative of
    jobs (job_id, title, description), a row for each. Whether it runs rules or asks a service, results are kept alike."""

    version: str

    def classify(self, jobs: DataFrame) -> DataFrame: ...


class RuleClassifier:
    """Required years, signals and title, with columns alone."""

    version = "rules-1"

    def classify(self, jobs: DataFrame) -> DataFrame:
        description = F.coalesce("description", F.lit(""))
        told = jobs.select("job_id", F.coalesce("title", F.lit("")).alias("title"), classify.required_years(description).alias("years"), classify.signals(description, classify.POSITIVE).alias("positive"), classify.signals(description, classify.NEGATIVE).alias("negative"))
        weight = F.aggregate(F.concat("positive", "negative"), F.lit(0), lambda a, x: a + x["weight"])
        level = classify.level(F.col("title"), F.col("years.min_years"), F.col("positive"), F.col("negative"))
        judged = told.select("job_id", level.alias("level"), weight.alias("weight"), "years.min_years", "years.max_years", "positive", "negative")
        return judged.withColumn("score", classify.score(F.col("level"), F.col("weight"))).drop("weight")


def input_hash(title: Column, description: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))).cast("binary"), 256)


def classify_due(jobs: DataFrame, history: DataFrame, classifier: Classifier, now: Column) -> tuple[DataFrame, DataFrame]:
    """history (RESULT) with is_current, and jobs (job_id, title, description, ...) with BLOCK, after the classifier has judged what is due.

    Due are jobs whose text has no result of this version; an unchanged text
    is not judged again, and older results stay. A job has the block of its
    newest result, or nulls. Empty tables give empty ones.
    """
    texts = jobs.select("job_id", "title", "description", input_hash(F.col("title"), F.col("description")).alias("input_hash"))
    due = settled(classify.to_classify(texts, history, classifier.version), "due")
    made = classifier.classify(due).join(due.select("job_id", "input_hash"), "job_id").withColumns({"version": F.lit(classifier.version), "created_at": now})
    names = [c.split()[0] for c in RESULT.split(", ")]
    kept = classify.current_only(settled(history.select(*names).unionByName(made.select(*names)), "results"))
    block = kept.filter("is_current").select("job_id", *[F.col(v).alias(k) for k, v in BLOCK.items()])
    return kept, jobs.drop(*BLOCK).join(block, "job_id", "left")
