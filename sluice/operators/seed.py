"""Seeds loaded into snapshot tables: upserts on natural keys, references as natural keys that are resolved to ids."""

from __future__ import annotations

import gc
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import SnapshotTable, settled

FAULT = T.StructType([T.StructField(c, T.StringType()) for c in ("entity", "natural_key", "problem")])


@dataclass(frozen=True)
class Entity:
    """A table of seeds.

    keys: its natural key, in which columns of references may stand. references:
    column for an id -> (entity, {key of that entity: column of the seed}).
    itself: such a column -> {key: column of the seed} for rows of the same
    entity, which may come in the same load. current: columns of which only the
    rows of the last load have is_current; they are the table's buckets then.
    """

    name: str
    keys: tuple[str, ...]
    references: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    itself: dict[str, dict[str, str]] = field(default_factory=dict)
    current: tuple[str, ...] = ()


_USER, _JOB = ("users", {"email": "user_email"}), ("jobs", {"dedup_hash": "job_hash"})
#: In the order of their references.
ENTITIES = (
    Entity("sources", ("key",)),
    Entity("users", ("email",)),
    Entity("profiles", ("user_id",), {"user_id": _USER}),
    Entity("jobs", ("dedup_hash",), itself={"merged_into": {"dedup_hash": "merged_into_hash"}}),
    Entity("postings", ("source_id", "external_id"), {"source_id": ("sources", {"key": "source_key"}), "job_id": _JOB}),
    Entity("classifications", ("job_id", "version", "input_hash"), {"job_id": _JOB}, current=("job_id",)),
    Entity("saved_jobs", ("user_id", "job_id"), {"user_id": _USER, "job_id": _JOB}),
)


def row_id(entity: Entity, by: dict[str, Column] | None = None) -> Column:
    """The same id for the same natural key, whenever it is loaded. by: the columns of a seed that name the entity's keys."""
    keys = [by[k].alias(k) if by else F.col(k) for k in entity.keys]
    return F.sha2(F.concat(F.lit(entity.name), F.to_json(F.struct(*keys))), 256)


def cleared(spark: SparkSession) -> None:
    """Shuffle files of plans that are done with are deleted once the driver's JVM has collected these as garbage, which it is asked to do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _names(rows: DataFrame, by: dict[str, str], id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in by.items()])


def resolved(entity: Entity, rows: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """rows whose references are there, still as natural keys, and FAULT rows.

    A row without a part of its key, or with a reference to no row, is a fault
    and is left out; so is one whose reference is null. Ids follow from natural
    keys, so that none are sent or written here: identified() adds them.
    """
    said = [c for _, by in entity.references.values() for c in by.values()]
    names = [c for c in dict.fromkeys((*said, *entity.keys)) if c in rows.columns]
    for id_col, (target, by) in entity.references.items():
        there = tables[target].select(F.lit(True).alias(f"__{id_col}"), *[F.col(k).alias(c) for k, c in by.items()])
        rows = rows.join(there, list(by.values()), "left")
    absent = [F.when(F.col(f"__{c}").isNull(), F.lit(f"no {target}")) for c, (target, _) in entity.references.items()]
    unnamed = [F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in entity.keys if k not in entity.references]
    marked = rows.withColumn("__problem", F.coalesce(*absent, *unnamed, F.lit(None).cast("string")))
    marked = settled(marked.drop(*[f"__{c}" for c in entity.references]), f"seed-{entity.name}")
    cleared(marked.sparkSession)
    faults = marked.filter("__problem is not null").select(F.lit(entity.name).alias("entity"), F.to_json(F.struct(*names)).alias("natural_key"), F.col("__problem").alias("problem"))
    return marked.filter("__problem is null").drop("__problem"), faults


def identified(entity: Entity, rows: DataFrame, ids: dict[str, Column], *by: str) -> DataFrame:
    """rows of resolved() as the entity stores them: id, their columns, ids for references. Of rows that repeat a key the greatest stays.

    by: columns that the key tells, by which rows are dealt already.
    """
    good = rows.withColumns(ids).drop(*[c for _, names in entity.references.values() for c in names.values()])
    value = [c for c in good.columns if c not in (*entity.keys, *by)]
    if value:
        good = good.groupBy(*by, *entity.keys).agg(F.max(F.struct(*value)).alias("v")).select(*by, *entity.keys, "v.*")
    else:
        good = good.distinct()
    return good.withColumn("id", row_id(entity))


def pointed(entity: Entity, rows: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """rows with ids for references within the entity, to rows of this load or stored ones, and FAULT rows.

    A row stays without its reference where that names no row, or itself.
    """
    faults = []
    for id_col, by in entity.itself.items():
        ids = rows.select("id", *entity.keys)
        if stored is not None:
            ids = ids.unionByName(stored.select("id", *entity.keys)).distinct()
        joined = rows.join(_names(ids, by, "__into"), list(by.values()), "left")
        asked = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in by.values()])
        wrong = asked & (F.col("__into").isNull() | (F.col("__into") == F.col("id")))
        faults.append(joined.filter(wrong).select(F.lit(entity.name).alias("entity"), F.to_json(F.struct(*entity.keys)).alias("natural_key"), F.lit(f"no {id_col}").alias("problem")))
        rows = joined.withColumn(id_col, F.when(~wrong, F.col("__into"))).drop("__into", *by.values())
    return rows, reduce(DataFrame.unionByName, faults)


def by_bucket(table: SnapshotTable, entity: Entity, rows: DataFrame, ids: dict[str, Column]) -> DataFrame:
    """rows of resolved() as the entity stores them, and __bucket: sent by bucket with natural keys alone, and made unique there."""
    mark = {"is_current": F.lit(True)} if entity.current else {}
    return identified(entity, table.dealt(rows.withColumns(ids), *ids), ids, "__bucket").withColumns(mark)


def first_load(spark: SparkSession, root: str, entity: Entity, rows: DataFrame, ids: dict[str, Column]) -> SnapshotTable:
    """rows of resolved() in a table that has none yet, so that there is nothing to compare them with."""
    mark = {"is_current": F.lit(True)} if entity.current else {}
    table = SnapshotTable.open_or_create(spark, f"{root}/{entity.name}", identified(entity, rows, ids).withColumns(mark).schema, list(entity.current or entity.keys))
    if rows.limit(1).count():
        table.append(by_bucket(table, entity, rows, ids))
    return table


def later_load(spark: SparkSession, root: str, entity: Entity, table: SnapshotTable, rows: DataFrame, ids: dict[str, Column]) -> SnapshotTable:
    """rows of resolved() in a table that has some: all are compared with those stored, and rows of buckets that differ are upserted."""
    made = by_bucket(table, entity, rows, ids)
    if unlike := table.unlike(made):
        return upsert(spark, root, entity, made.filter(F.col("__bucket").isin(unlike)).drop("__bucket"))
    return table


def upsert(spark: SparkSession, root: str, entity: Entity, rows: DataFrame) -> SnapshotTable:
    """rows in the entity's table: buckets of their keys are written again, and none if the table holds all rows as they are."""
    if entity.current:
        rows = rows.withColumn("is_current", F.lit(True))
    table = SnapshotTable.open_or_create(spark, f"{root}/{entity.name}", rows.schema, list(entity.current or entity.keys))
    rows = settled(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]), "seed-rows")
    if not rows.exceptAll(table.read(only=table.touched(rows))).limit(1).count():
        return table

    def change(old: DataFrame) -> DataFrame:
        others = old.join(rows.select("id"), "id", "left_anti")
        if entity.current:
            group = rows.select(*entity.current, F.lit(True).alias("__newer")).distinct()
            others = others.join(group, list(entity.current), "left").withColumn("is_current", F.col("is_current") & F.col("__newer").isNull())
        return others.select(*rows.columns).unionByName(rows)

    table.rewrite(rows, change)
    return table


def load(spark: SparkSession, root: str, seeds: dict[str, DataFrame], entities: Iterable[Entity] = ENTITIES) -> tuple[dict[str, SnapshotTable], DataFrame]:
    """The tables below root after seeds (entity -> rows) were loaded, and the FAULT rows of this load.

    Seeds may leave entities out; what they refer to must be loaded then or
    before. Loading the same seeds again changes no table and adds no version.
    """
    tables, faults = {}, spark.createDataFrame([], FAULT)
    known: dict[str, Entity] = {}
    for e in entities:
        known[e.name] = e
        path = f"{root}/{e.name}"
        if e.name in seeds:
            read = {t: tables[t].read() for t, _ in e.references.values()}
            ids = {c: row_id(known[t], {k: F.col(n).cast(read[t].schema[k].dataType) for k, n in by.items()}) for c, (t, by) in e.references.items()}
            before, rows = tables_at(spark, path), seeds[e.name]
            if before is not None:  # ids and buckets follow from keys as they are stored
                rows = rows.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in before.schema if f.name in rows.columns})
            rows, wrong = resolved(e, rows, read)
            faults = faults.unionByName(wrong)
            if e.itself:
                rows, wrong = pointed(e, settled(identified(e, rows, ids), "seed-ids"), before and before.read())
                faults = faults.unionByName(wrong)
                tables[e.name] = upsert(spark, root, e, rows)
            elif before is not None and before.version():
                tables[e.name] = later_load(spark, root, e, before, rows, ids)
            else:
                tables[e.name] = first_load(spark, root, e, rows, ids)
            cleared(spark)
        elif (stored := tables_at(spark, path)) is not None:
            tables[e.name] = stored
    return tables, faults


def tables_at(spark: SparkSession, path: str) -> SnapshotTable | None:
    """The table at path if there is one."""
    return SnapshotTable(spark, path) if SnapshotTable.exists(spark, path) else None
