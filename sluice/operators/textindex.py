"""A stored inverted index, and tables of queries that are evaluated by joins on its lexemes.

An entry is a lexeme of a document with its places and what it counts for the
rank. Entries lie in buckets of their lexeme's hash, and a search opens the
buckets of its queries' lexemes alone. The rarest wanted lexeme of each
alternative names the candidates; its other terms are looked up for these only,
so that a common word costs one pass over its list, not a row for each query
and document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.search import WEIGHTS, parse_query
from ..storage import SnapshotTable, settled

ENTRY = "configuration string, lexeme string, key bigint, score double, positions array<int>"
LEXEME = "configuration string, lexeme string, documents bigint"
DOCUMENT = "key bigint, configuration string"
#: A lexeme of a query: its alternative (grp) and term, whether the term is wanted, its place among the term's `size`
#: lexemes, and how many terms of the alternative are wanted.
TERM = "query_id bigint, configuration string, grp int, term int, wanted boolean, at int, size int, lexeme string, n_wanted int"


def entries(vectors: DataFrame) -> DataFrame:
    """Entries of documents (key, configuration, vector): a row for each lexeme, whatever parts of the document it is in."""
    each = vectors.select("key", "configuration", F.explode("vector").alias("x"))
    counts = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])
    score = F.try_element_at(counts, F.col("x.weight")) * F.log1p(F.size("x.positions"))
    grouped = each.groupBy("configuration", F.col("x.lexeme").alias("lexeme"), "key").agg(F.sum(score).alias("score"), F.sort_array(F.flatten(F.collect_list("x.positions"))).alias("positions"))
    return grouped


def terms(queries: DataFrame) -> DataFrame:
    """The lexemes of queries (query_id, configuration, query). Queries without words have none."""
    names = [c.split()[0] for c in TERM.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, conf, said in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for g, group in enumerate(parse_query(said or "", conf)):
                    n = sum(wanted for wanted, _ in group)
                    rows += [(q, conf, g, t, wanted, i, len(row), lexeme, n) for t, (wanted, row) in enumerate(group) for i, lexeme in enumerate(row)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return queries.select("query_id", "configuration", "query").mapInArrow(run, TERM)


def _followed(lists: Column) -> Column:
    """Whether arrays of first places of a term, one for each of its lexemes, have one in common."""
    none = F.lit(None).cast("array<int>")
    return F.size(F.aggregate(lists, none, lambda a, x: F.when(a.isNull(), x).otherwise(F.array_intersect(a, x)))) > 0


class TextIndex:
    """Entries, how many documents have a lexeme, and documents, as snapshot tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.entries, self.lexemes, self.documents = (SnapshotTable(spark, f"{root}/{t}") for t in ("entries", "lexemes", "documents"))

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 32) -> TextIndex:
        for name, ddl, keys in (("entries", ENTRY, ["configuration", "lexeme"]), ("lexemes", LEXEME, ["configuration", "lexeme"]), ("documents", DOCUMENT, ["key"])):
            SnapshotTable.create(spark, f"{root}/{name}", spark.createDataFrame([], ddl).schema, keys, buckets)
        return cls(spark, root)

    def add(self, vectors: DataFrame) -> None:
        """Index documents (key, configuration, vector) that are not in the index.

        How many documents have a lexeme is only used to choose where a search
        begins: results do not depend on it.
        """
        vectors = settled(vectors.select("key", "configuration", "vector"), "vectors")
        new = settled(entries(vectors), "entries")
        self.entries.append(new)
        self.documents.append(vectors.select("key", "configuration"))
        counts = settled(new.groupBy("configuration", "lexeme").agg(F.count("*").alias("documents")), "lexemes")
        self.lexemes.rewrite(counts, lambda old: old.unionByName(counts).groupBy("configuration", "lexeme").agg(F.sum("documents").alias("documents")))

    def lists(self, wanted: DataFrame) -> DataFrame:
        """The entries of lexemes (configuration, lexeme)."""
        keys = ["configuration", "lexeme"]
        return self.entries.read(only=self.entries.touched(wanted)).join(wanted.select(*keys).distinct(), keys, "left_semi")

    def _held(self, asked: DataFrame, lists: DataFrame, by: list[str]) -> DataFrame:
        """Terms that documents have: by, key, wanted. asked: lexemes of terms, for some documents if it has a key."""
        on = ["configuration", "lexeme", *(["key"] if "key" in asked.columns else [])]
        found = asked.join(lists, on).withColumn("begins", F.transform("positions", lambda p: p - F.col("at")))
        per = found.groupBy(*by, "key", "term", "wanted", "n_wanted", "size").agg(F.collect_list("begins").alias("lists"))
        return per.filter((F.size("lists") == F.col("size")) & ((F.col("size") == 1) | _followed(F.col("lists"))))

    def search(self, queries: DataFrame, top: int | None = None) -> DataFrame:
        """query_id, key and rank of the documents that fit queries (query_id, configuration, query), of their own configuration.

        Words must all occur, quotes make phrases, a minus excludes, or parts
        alternatives. The rank sums what the wanted lexemes of all alternatives
        count. top: only so many of each query, by rank and then least key.
        Queries without words fit nothing, an empty table gives an empty table;
        query ids are unique.
        """
        asked = settled(terms(queries), "terms")
        lists = self.lists(asked)
        by = ["query_id", "configuration", "grp"]
        known = self.lexemes.read(only=self.lexemes.touched(asked))
        wanted = asked.filter("wanted").join(known, ["configuration", "lexeme"], "left")
        lead = wanted.groupBy(*by).agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("n"), "lexeme")).alias("x")).select(*by, "x.lexeme")
        candidates = lead.join(lists.select("configuration", "lexeme", "key"), ["configuration", "lexeme"]).drop("lexeme")
        held = self._held(candidates.join(asked, by), lists, by)
        counts = held.groupBy(*by, "key", "n_wanted").agg(F.count_if("wanted").alias("has"), F.count_if(~F.col("wanted")).alias("must_not"))
        fits = counts.filter("has = n_wanted AND must_not = 0").select("query_id", "configuration", "key")
        # alternatives that only exclude fit all documents but those that have a term
        only_not = asked.filter("n_wanted = 0")
        rest = only_not.select(*by).distinct().join(self.documents.read(), "configuration").join(self._held(only_not, lists, by), [*by, "key"], "left_anti")
        fits = fits.unionByName(rest.select("query_id", "configuration", "key")).distinct()
        scored = fits.join(asked.filter("wanted").select("query_id", "configuration", "lexeme").distinct(), ["query_id", "configuration"]).join(lists.select("configuration", "lexeme", "key", "score"), ["configuration", "lexeme", "key"])
        ranks = scored.groupBy("query_id", "key").agg(F.sum("score").alias("rank"))
        out = fits.select("query_id", "key").join(ranks, ["query_id", "key"], "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
        if top is None:
            return out
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "key"))
        return out.withColumn("place", place).filter(F.col("place") <= top).drop("place")
