"""Tables as versioned snapshots in a folder that all executors share.

A snapshot table is a set of Parquet folders, one for each bucket of its key's
hash, and a list of versions. A version names the folders that make it up, so
that readers of a version are never disturbed. A write puts new files into a
folder of its own and then adds a version by renaming one file to a name that
must not exist yet: until then nothing has changed, afterwards all has. Only the
buckets that a batch touches are read and written again.
"""

from __future__ import annotations

import json
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has added a version since this one began."""


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below spark.checkpoint.dir; a session on one machine that names none gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read back, for what is used more than once."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Files:
    """The few file operations that a version needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, root
        self.hadoop = self.jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.path("").toUri(), conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write text under another name, then give it its own unless that exists."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            if self.fs.exists(self.path(name)):
                raise Conflict(name)
            self.context.rename(self.path(draft), self.path(name), none)
        except Conflict:
            raise
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise
        finally:
            if self.fs.exists(self.path(draft)):
                self.fs.delete(self.path(draft), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class SnapshotTable:
    """Rows by key in `buckets` buckets. One writer at a time; a second one gets Conflict. Any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root.rstrip("/"))
        facts = json.loads(self.files.read("table.json"))
        self.keys, self.buckets, self.schema = facts["keys"], facts["buckets"], T.StructType.fromJson(facts["schema"])

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 32) -> SnapshotTable:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        _Files(spark, root.rstrip("/")).publish("table.json", json.dumps({"keys": keys, "buckets": buckets, "schema": schema.jsonValue()}))
        return cls(spark, root)

    def version(self) -> int:
        """The newest version; 0 has no rows."""
        return max((int(n[:-5]) for n in self.files.names("versions") if re.fullmatch(r"\d+\.json", n)), default=0)

    def folders(self, version: int | None = None) -> dict[int, list[str]]:
        version = self.version() if version is None else version
        return {int(b): f for b, f in json.loads(self.files.read(f"versions/{version:010d}.json")).items()} if version else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the newest), or of some of its buckets; other buckets' files are not opened."""
        folders = self.folders(version)
        paths = [f"{self.root}/{f}" for b, fs in sorted(folders.items()) if only is None or b in only for f in fs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def dealt(self, rows: DataFrame, *derived: str) -> DataFrame:
        """rows by bucket, the number of which is in __bucket, for append(). Of the columns named, that others tell, none is sent."""
        return rows.withColumn("__bucket", self.bucket()).drop(*derived).repartition("__bucket")

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        name = f"data/{uuid.uuid4().hex}"
        if "__bucket" not in rows.columns:
            rows = self.dealt(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]))
        fitted = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], "__bucket")
        fitted.write.partitionBy("__bucket").parquet(f"{self.root}/{name}", compression="zstd")
        return {int(n.split("=")[1]): [f"{name}/{n}"] for n in self.files.names(name) if n.startswith("__bucket=")}

    def unlike(self, rows: DataFrame) -> list[int]:
        """The buckets of rows, which have their number in __bucket, that do not hold exactly these rows.

        A bucket's rows are told by their number and by sums of digests (64 bits of their values, 120 of them as JSON) under
        a key that is drawn for this call alone, so that each row is read and none is sent.
        """
        key, names = F.lit(secrets.token_hex(16)), [f"`{f.name}`" for f in self.schema]
        digest = F.sha2(F.concat(key, F.to_json(F.struct(*names))), 256).alias("digest")
        parts = [F.col("hash"), *[F.conv(F.substring("digest", at, 15), 16, 10) for at in (1, 16)]]
        sums = [F.sum(p.cast("decimal(20,0)")) for p in parts]

        def told(df: DataFrame) -> dict[int, tuple]:
            fitted = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], "__bucket")
            return {b: tuple(x) for b, *x in fitted.select("__bucket", F.xxhash64(key, *names).alias("hash"), digest).groupBy("__bucket").agg(F.count("*"), *sums).collect()}

        new = told(rows)
        old = told(self.read(only=list(new)).withColumn("__bucket", self.bucket()))
        return sorted(b for b in new if new[b] != old.get(b))

    def _publish(self, base: int, folders: dict[int, list[str]]) -> int:
        self.files.publish(f"versions/{base + 1:010d}.json", json.dumps(folders))
        return base + 1

    def append(self, rows: DataFrame) -> int:
        """A version with rows added (those of dealt() are not sent again); existing files stay as they are."""
        base = self.version()
        folders = self.folders(base)
        for b, new in self._write(rows).items():
            folders[b] = folders.get(b, []) + new
        return self._publish(base, folders)

    def replace(self, rows: DataFrame) -> int:
        """A version of these rows alone."""
        base = self.version()
        return self._publish(base, self._write(rows))

    def rewrite(self, batch: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """A version in which the buckets of batch hold change(their rows); the others keep their files.

        batch has the key columns; change must keep to rows of those buckets.
        """
        base = self.version()
        touched = self.touched(batch)
        folders = self.folders(base)
        made = self._write(change(self.read(base, touched)))
        if extra := set(made) - set(touched):
            raise ValueError(f"rows of buckets that the batch does not touch: {sorted(extra)}")
        kept = {b: f for b, f in folders.items() if b not in touched}
        return self._publish(base, kept | made)

    def compact(self, most: int = 8) -> int | None:
        """A version in which buckets of more than `most` folders, as appends leave them, have one each; None if none has."""
        base = self.version()
        folders = self.folders(base)
        many = [b for b, f in folders.items() if len(f) > most]
        if not many:
            return None
        return self._publish(base, {b: f for b, f in folders.items() if b not in many} | self._write(self.read(base, many)))

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return "table.json" in _Files(spark, root.rstrip("/")).names("")

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 32) -> SnapshotTable:
        if cls.exists(spark, root):
            return cls(spark, root)
        return cls.create(spark, root, schema, keys, buckets)

    def expire(self, keep: int = 2) -> None:
        """Forget all but the newest versions, and delete the files that only they have. No one may read those any more."""
        newest = self.version()
        numbers = sorted(int(n[:-5]) for n in self.files.names("versions") if re.fullmatch(r"\d+\.json", n))
        used = {f.split("/")[1] for v in numbers if v > newest - keep for fs in self.folders(v).values() for f in fs}
        for v in numbers:
            if v <= newest - keep:
                self.files.delete(f"versions/{v:010d}.json")
        for name in self.files.names("data"):
            if name not in used:
                self.files.delete(f"data/{name}")
