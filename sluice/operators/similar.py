"""Tier 3 as assignment: new postings join stored jobs by similar titles of one employer.

Jobs are indexed once, when they are made, by the prefix of their titles'
trigrams in a fixed order, rare ones first: two titles of similarity t share a
gram of their first n - ceil(t n) + 1. An entry also has the number of grams and
the gram's place, from which follows what two titles can share at most; entries
of a gram are split into bands by the number of grams, since neither of two
similar titles has fewer than t times the grams of the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import SnapshotTable, settled
from .resolve import distinct_words, trigram_similarity, trigrams

#: Least similarity of titles, and of the distinct words of descriptions.
TITLES, DESCRIPTIONS = 0.6, 0.5

ORDER = "gram int, often bigint"
ENTRY = "block string, gram int, band int, n int, place int, job_id string"
TITLE = "block string, job_id string, grams array<int>, words array<bigint>"


def grams(title: Column) -> Column:
    """The trigrams of a title as numbers; there are at most 37 ** 3."""
    digit = lambda c: F.instr(F.lit(" abcdefghijklmnopqrstuvwxyz0123456789"), c) - 1
    return F.transform(trigrams(title), lambda g: (digit(F.substring(g, 1, 1)) * 37 + digit(F.substring(g, 2, 1))) * 37 + digit(F.substring(g, 3, 1)))


def described(rows: DataFrame, block: str, key: str, title: str, description: str) -> DataFrame:
    """block, key, grams and words of rows that have a block and a title with letters or digits. Rows are dealt out first: a small file would be one task."""
    said = rows.select(F.col(block).cast("string").alias("block"), F.col(key).alias("key"), F.col(title).alias("title"), F.col(description).alias("description")).repartition("block", "key")
    out = said.select("block", "key", grams(F.col("title")).alias("grams"), distinct_words(F.col("description")).alias("words"))
    return out.filter(F.col("block").isNotNull() & (F.size("grams") > 0))


def prefixes(rows: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """block, key, gram, n, place of the grams that can be the first shared one. order (gram, often) has a row for each trigram at most: 50,653."""
    each = rows.select("block", "key", F.explode("grams").alias("gram")).join(F.broadcast(order), "gram", "left")
    placed = each.groupBy("block", "key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("g"))
    n = F.size("g")
    first = F.slice("g", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    return placed.select("block", "key", n.alias("n"), F.posexplode(first).alias("at", "x")).select("block", "key", F.col("x.gram").alias("gram"), "n", (F.col("at") + 1).alias("place"))


def band(n: Column, threshold: float) -> Column:
    """Titles whose numbers of grams differ by no more than the threshold are in the same band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")


class TitleIndex:
    """Prefixes and titles of jobs as snapshot tables, by employer."""

    def __init__(self, spark: SparkSession, root: str, titles: float = TITLES, descriptions: float = DESCRIPTIONS):
        self.order, self.entries, self.titles = (SnapshotTable(spark, f"{root}/{t}") for t in ("order", "entries", "titles"))
        self.least, self.confirm = titles, descriptions

    @classmethod
    def create(cls, spark: SparkSession, root: str, sample: DataFrame | None = None, title: str = "normalized_title", buckets: int = 32, **thresholds: float) -> TitleIndex:
        """An empty index. sample: rows whose titles tell how often trigrams occur; any order is right, a good one is fast."""
        empty = lambda ddl: spark.createDataFrame([], ddl).schema
        order = SnapshotTable.create(spark, f"{root}/order", empty(ORDER), ["gram"], 1)
        SnapshotTable.create(spark, f"{root}/entries", empty(ENTRY), ["block"], buckets)
        SnapshotTable.create(spark, f"{root}/titles", empty(TITLE), ["block"], buckets)
        if sample is not None:
            told = sample.groupBy(F.col(title).alias("title")).agg(F.count("*").alias("n"))
            order.replace(told.select(F.explode(grams(F.col("title"))).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("often")))
        return cls(spark, root, **thresholds)

    def add(self, jobs: DataFrame, block: str = "company_slug", key: str = "job_id", title: str = "normalized_title", description: str = "description") -> None:
        """Index jobs that are not in the index. Those without a block or a title's letters can't be similar to any."""
        rows = settled(described(jobs, block, key, title, description), "described")
        entries = prefixes(rows, self.order.read(), self.least)
        self.titles.append(rows.withColumnRenamed("key", "job_id"))
        self.entries.append(entries.withColumn("band", band(F.col("n"), self.least)).withColumnRenamed("key", "job_id"))

    def pairs(self, rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
        """block, key, job_id and similarity of all similar titles. rows: as of described(). among: only with these of the index's titles.

        The parts of the index that belong to these employers are read. Pairs
        meet with keys alone, and titles are fetched once for each.
        """
        touched = self.entries.touched(rows)
        asked = prefixes(rows, self.order.read(), self.least).withColumn("band", band(F.col("n"), self.least))
        a = asked.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("a")
        b = self.entries.read(only=touched)
        b = (b if among is None else b.join(among.select("block", "job_id"), ["block", "job_id"], "left_semi")).alias("b")
        t = self.least
        needed = F.ceil(F.lit(t / (1 + t)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
        shared = F.least("a.place", "b.place") + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
        fits = (F.col("a.n") >= t * F.col("b.n") - 1e-9) & (F.col("b.n") >= t * F.col("a.n") - 1e-9) & (shared >= needed)
        met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.band") == F.col("b.band")) & fits)
        met = met.select("a.block", "a.key", "b.job_id").distinct()
        scored = met.join(rows.select("block", "key", "grams"), ["block", "key"]).join((self.titles.read(only=touched) if among is None else among).select("block", "job_id", F.col("grams").alias("theirs")), ["block", "job_id"])
        return scored.select("block", "key", "job_id", trigram_similarity(F.col("grams"), F.col("theirs")).alias("similarity")).filter(F.col("similarity") >= t)

    def best(self, postings: DataFrame, block: str = "company_slug", key: str = "posting_id", title: str = "normalized_title", description: str = "description") -> DataFrame:
        """key, job_id, similarity, confirmed: the job that each posting joins, of those with a similar title and description.

        The most similar title decides, then the description, then the least
        job_id. Postings without such a job are left out: they make a new one,
        for a job that is split is a smaller fault than one that hides another.
        Descriptions without words confirm nothing. An empty table gives an
        empty table; rows that repeat a key give one row.
        """
        # of equal titles with equal words one asks, and the least job_id answers
        same = ["block", "grams", "words"]
        rows = settled(described(postings, block, key, title, description).dropDuplicates(["block", "key"]), "asking")
        asked = settled(rows.groupBy(*same).agg(F.min("key").alias("key")), "asking-titles")
        stored = settled(self.titles.read(only=self.titles.touched(asked)).groupBy(*same).agg(F.min("job_id").alias("job_id")), "asked-titles")
        theirs = stored.select("block", "job_id", F.col("words").alias("theirs"))
        # sizes first: neither description may have less than `confirm` times the other's words
        sized = self.pairs(asked, stored).join(asked.select("block", "key", F.size("words").alias("n")), ["block", "key"]).join(theirs.select("block", "job_id", F.size("theirs").alias("m")), ["block", "job_id"])
        fit = sized.filter((F.col("n") >= self.confirm * F.col("m") - 1e-9) & (F.col("m") >= self.confirm * F.col("n") - 1e-9)).drop("n", "m")
        both = fit.join(asked.select("block", "key", "words"), ["block", "key"]).join(theirs, ["block", "job_id"])
        sure = both.withColumn("confirmed", trigram_similarity(F.col("words"), F.col("theirs"))).filter(F.col("confirmed") >= self.confirm)
        place = F.struct(-F.col("similarity"), -F.col("confirmed"), F.col("job_id").alias("job_id"), F.col("similarity").alias("similarity"), F.col("confirmed").alias("confirmed"))
        answers = sure.groupBy("block", "key").agg(F.min(place).alias("b")).join(asked, ["block", "key"]).select(*same, "b")
        return rows.join(answers, same).groupBy("key").agg(F.min("b").alias("b")).select(F.col("key").alias(key), "b.job_id", "b.similarity", "b.confirmed")
