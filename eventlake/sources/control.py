"""Control tables: small rows by key that batches update in place (offsets, visibility, views), stored as bucketed versions.

Keys are dealt to a fixed number of buckets. A batch reads and rewrites only the
buckets that its keys are in; a manifest of at most one row a bucket, written last,
tells which version of each is current. A batch that fails before its manifest is
written leaves the table as it was; one that comes again under the same number
changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import folder_names, remove_folder

Rule = Callable[[Column, Column], Column]


def last(value: Column, order: Column) -> Column:
    """The latest value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def largest(value: Column, order: Column) -> Column:
    return F.max(value)


def united(value: Column, order: Column) -> Column:
    """All elements of all arrays, each once, in order of their own."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(value, F.array().cast("array<string>"))))))


@dataclass
class ControlTable:
    """Rows (keys, columns) below a path; ``rules`` tell how each column's values of one key become one.

    Only one writer at a time; readers always see whole batches. Rows with a null
    key are left out.
    """

    spark: SparkSession
    path: str
    keys: dict[str, str]
    columns: dict[str, str]
    rules: dict[str, Rule] = field(default_factory=dict)
    buckets: int = 64

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in (self.keys | self.columns).items())

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, version string, batch long, number long").parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self) -> tuple[int, int | None, dict[int, str]]:
        """(number, last batch, version of each bucket) of the current state; a row a bucket at most comes to the driver."""
        every = self._manifests()
        newest = None if every is None else every.agg(F.max("number")).first()[0]
        if newest is None:
            return 0, None, {}
        rows = every.where(F.col("number") == newest).collect()
        return newest, max((r.batch for r in rows if r.batch is not None), default=None), {r.bucket: r.version for r in rows if r.version is not None}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast(t) for k, t in self.keys.items())), F.lit(self.buckets)).cast("int")

    def _rows(self, versions: dict[int, str]) -> DataFrame:
        """Rows of some buckets; only their folders are named to Spark."""
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())))

    def read(self) -> DataFrame:
        return self._rows(self.manifest()[2])

    def lookup(self, keys: DataFrame, **defaults: object) -> DataFrame:
        """keys with the table's columns, of which those without a row have their default; reads the buckets of the keys only."""
        wanted = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # a number a bucket
        rows = self._rows({b: v for b, v in self.manifest()[2].items() if b in wanted})
        found = keys.select(*self.keys).distinct().join(rows, list(self.keys), "left")
        return found.withColumns({c: F.coalesce(c, F.lit(v).cast(self.columns[c])) for c, v in defaults.items()})

    def upsert(self, batch: DataFrame, number: int | None = None, order: Column | None = None) -> bool:
        """Merge a batch into the table; False if its number, or a later one, has been merged already.

        Columns that the batch lacks stay as they are. ``order`` tells which of a
        key's rows in the batch is the later one.
        """
        newest, done, versions = self.manifest()
        if number is not None and done is not None and number <= done:
            return False
        given = [c for c in self.columns if c in batch.columns]
        rows = batch.where(" and ".join(f"`{k}` is not null" for k in self.keys))
        rows = rows.select(*(F.col(k).cast(t).alias(k) for k, t in self.keys.items()), *((F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in self.columns.items()), (F.lit(None) if order is None else order).alias("_order"), F.lit(1).alias("_turn"))
        rows = rows.withColumn("bucket", self._bucket())
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # a number a bucket
        version = uuid.uuid4().hex
        if touched:
            before = self._rows({b: v for b, v in versions.items() if b in touched}).withColumns({"_order": F.lit(None), "_turn": F.lit(0), "bucket": self._bucket()})
            when = F.struct("_turn", "_order")
            merged = before.unionByName(rows).groupBy("bucket", *self.keys).agg(*(self.rules.get(c, last)(F.col(c), when).alias(c) for c in self.columns))
            merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        versions = versions | dict.fromkeys(touched, version)
        state = [(b, v) for b, v in versions.items()] or [(None, None)]
        kept = done if number is None else number
        state = self.spark.createDataFrame([(b, v, kept) for b, v in state], "bucket int, version string, batch long")
        state.coalesce(1).write.parquet(f"{self.path}/manifest/number={newest + 1}")
        return True

    def apply(self, make: Callable[[DataFrame], DataFrame] | None = None, order: Column | None = None) -> Callable[[DataFrame, int], None]:
        """An apply function of materialize: each batch, or what ``make`` makes of it, is merged once under its number.

        Negative numbers (replays) are merged without one.
        """

        def run(batch: DataFrame, number: int) -> None:
            self.upsert(batch if make is None else make(batch), number if number >= 0 else None, order)

        return run

    def expire(self) -> int:
        """Remove manifests and versions that the current state doesn't need; the number of removed folders. No reader may be on them."""
        newest, _, versions = self.manifest()
        gone = 0
        for part, keep in (("manifest", {f"number={newest}"}), ("data", {f"version={v}" for v in versions.values()})):
            for name in folder_names(self.spark, f"{self.path}/{part}"):
                if "=" in name and name not in keep:
                    gone += remove_folder(self.spark, f"{self.path}/{part}/{name}")
        return gone


def offsets(spark: SparkSession, path: str) -> ControlTable:
    """Offsets by site and tag; a lookup of what isn't there is 0 with ``offset=0``."""
    return ControlTable(spark, path, {"site": "string", "tag": "string"}, {"offset": "long"})


def visibility(spark: SparkSession, path: str, buckets: int = 64) -> ControlTable:
    """Sites and master of entities: sites are added, the master is the one set last."""
    return ControlTable(spark, path, {"persistence_id": "string"}, {"master": "boolean", "sites": "array<string>"}, {"sites": united}, buckets)
