"""Boards as JSON files: a scan with columns alone, and faults as rows.

A board is a text with a `jobs` array, in a file of its own or, where boards are
many, in a pack: a file system takes much longer over a small file than Spark
over its board. Files are read by Spark; the options of a scan hold paths,
never contents. What a paginated source would do page by page
is told from positions: the page cap, the stop at a page without usable entries,
the stop at or filter of older entries, and the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import scan
from ..storage import settled

ITEM = ["source", "pos", "external_id", "url", "payload", "posted_at"]
FAULT = ["source", "pos", "problem", "payload"]
PACK = "source string, text string"


def read_boards(spark: SparkSession, path: str, source: Column | None = None) -> DataFrame:
    """source and text of the files below path. source: what names a board, by default the file's name without its ending.

    Spark passes by files of no bytes, so they are no boards.
    """
    named = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "") if source is None else source
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(named.alias("source"), F.col("value").alias("text"))


def pack_boards(boards: DataFrame, path: str) -> None:
    """Write boards (source, text) as packs below path: Parquet files with a board a row, one for each of the partitions that have any."""
    boards.select("source", "text").write.parquet(path, compression="zstd")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """source and text of all boards in the packs below path. Texts are as they were given, empty ones too."""
    return spark.read.schema(PACK).parquet(path)


def _kind(v: Column) -> Column:
    """A variant's kind: OBJECT, ARRAY, STRING, BIGINT, ... VOID for null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def parse_boards(boards: DataFrame) -> DataFrame:
    """source, pos, entry of boards (source, text). A board that has no entries to give is a row without a position, with its problem and text."""
    parsed = boards.select("source", "text", F.try_parse_json("text").alias("v")).withColumn("jobs", F.try_variant_get("v", "$.jobs", "variant"))
    problem = F.when(F.col("v").isNull(), "not JSON").when(F.coalesce(_kind(F.col("jobs")), F.lit("")) != "ARRAY", "no array of jobs")
    judged = parsed.withColumn("problem", problem)
    whole = F.col("problem").isNull()
    listed = judged.select("source", "problem", F.when(~whole, F.col("text")).alias("text"), F.when(whole, F.col("jobs").cast("array<variant>")).alias("jobs"))
    return listed.select("source", "problem", "text", F.posexplode_outer("jobs").alias("pos", "entry")).filter("problem IS NOT NULL OR pos IS NOT NULL")


def entry_problem(entry: Column) -> Column:
    """Why an entry can't be an item, or null. Types are told before values are taken, for a cast would make "5" of 5."""
    text = lambda name: F.when(_kind(F.try_variant_get(entry, f"$.{name}", "variant")) == "STRING", F.try_variant_get(entry, f"$.{name}", "string"))
    return F.when(_kind(entry) != "OBJECT", "no object").when(F.coalesce(text("id"), F.lit("")) == "", "id").when(~F.coalesce(F.startswith(text("url"), F.lit("https://")), F.lit(False)), "url")


def scan_boards(boards: DataFrame, page_size: int = 20, max_pages: int = 10, since: Column | None = None, recent_first: bool = False, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Items (ITEM) of boards (source, text), and FAULT rows of boards and of entries on the pages that were looked at.

    Null entries are neither. A page without a usable entry ends its board, as
    do, after the page cap, what ingest.scan() says of since and limit. A
    postedAt that is no time counts as none. Boards are scanned in parallel;
    a null or empty text is a board that is not JSON. Texts are read and parsed
    once; what was told of the entries is written down, and all else is found from that.
    """
    text = lambda name: F.try_variant_get("entry", f"$.{name}", "string")
    posted = F.try_to_timestamp(F.when(_kind(F.try_variant_get("entry", "$.postedAt", "variant")) == "STRING", text("postedAt")))
    there = (F.col("pos") < page_size * max_pages) & F.col("entry").isNotNull() & ~F.is_variant_null("entry")
    told = parse_boards(boards).filter(F.col("problem").isNotNull() | there).select(
        "source", "pos", F.floor(F.col("pos") / page_size).cast("int").alias("page"), F.when(F.col("pos").isNull(), F.col("problem")).otherwise(entry_problem(F.col("entry"))).alias("problem"),
        text("id").alias("external_id"), text("url").alias("url"), F.when(F.col("pos").isNull(), F.col("text")).otherwise(F.to_json("entry")).alias("payload"), posted.alias("posted_at"),
    )
    told = settled(told, "entries")
    entries, broken = told.filter("pos IS NOT NULL"), told.filter("pos IS NULL").select(*FAULT)
    # the first page without a usable entry; at most max_pages numbers a board
    full = entries.filter("problem IS NULL").groupBy("source").agg(F.collect_set("page").alias("pages"))
    ends = full.select("source", F.get(F.filter(F.sequence(F.lit(0), F.lit(max_pages)), lambda p: ~F.array_contains("pages", p)), F.lit(0)).alias("end"))
    seen = entries.join(ends, "source", "left").filter(F.col("page") <= F.coalesce("end", F.lit(0)))
    item, faults = seen.filter("problem IS NULL").select(*ITEM), seen.filter("problem IS NOT NULL").select(*FAULT)
    return scan(item, "pos", "posted_at", since=since, recent_first=recent_first, limit=limit, source="source"), broken.unionByName(faults)
