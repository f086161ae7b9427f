"""A partitioned Parquet lake with bronze, silver and gold levels.

The partition column lives in the path only. Writes swap whole partitions at
job commit (dynamic partition overwrite); one writer per partition is assumed.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalars as S
from panelloom.operators import quality
from panelloom.operators.normalize import partition_column, strict_types
from panelloom.schemas import DatasetSpec, dataset, level_name
from panelloom.session import stored

# Days per retention unit.
RETENTION_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object: driver-side listing of directory names only."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def retention_cutoff(older_than: str, today: dt.date) -> dt.date:
    """An ISO date, or an age such as 180d, 12w, 6m, 2y counted back from today."""
    text = older_than.strip().lower()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return dt.date.fromisoformat(text)
    match = re.fullmatch(r"(\d+)([dwmy])", text)
    if not match:
        raise ValueError(f"cannot read retention age {older_than!r}")
    return today - dt.timedelta(days=int(match[1]) * RETENTION_DAYS[match[2]])


def expired(partitions: DataFrame, cutoff: dt.date | None, keep_last: int | None) -> DataFrame:
    """Partitions before the cut-off (the cut-off itself stays), except the newest ones.

    `partitions` is (partition, day). The newest `keep_last` are found by a sorted
    limit, so no single-task ranking of all partitions is needed.
    """
    if cutoff is None and keep_last is None:
        raise ValueError("give a cut-off, a number of partitions to keep, or both")
    if keep_last is not None and keep_last < 1:
        raise ValueError("keep at least one partition")
    dropped = partitions
    if cutoff is not None:
        dropped = dropped.where(F.col("day") < F.lit(cutoff))
    if keep_last:
        newest = partitions.orderBy(F.desc("day"), F.desc("partition")).limit(keep_last)
        dropped = dropped.join(newest.select("partition"), "partition", "left_anti")
    return dropped


@contextmanager
def every_shuffle_partition(spark: SparkSession):
    """Keep all shuffle partitions of a write.

    Its cost is the number of partition folders rather than the bytes, so merging
    small shuffle partitions would put thousands of folders on one task. Splitting
    of oversized partitions stays on.
    """
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # --- reading ----------------------------------------------------------------------

    def path(self, name: str, level: str | None = None) -> str:
        return f"{self.root}/{level_name(level or dataset(name).level)}/{name}"

    def _schema(self, spec: DatasetSpec, path: str) -> T.StructType:
        kind = T.DateType() if spec.partition == "dt" else T.StringType()
        fields = list(spec.schema.fields)
        if spec.open_schema and path_exists(self.spark, path):
            found = self.spark.read.option("mergeSchema", True).parquet(path).schema
            known = {f.name for f in fields} | {spec.partition}
            fields += [f for f in found.fields if f.name not in known]
        if spec.partition not in spec.columns:
            fields.append(T.StructField(spec.partition, kind))
        return T.StructType(fields)

    def scan(self, name: str, level: str | None = None) -> DataFrame:
        """All rows with the declared types; a missing dataset is empty."""
        spec, path = dataset(name), self.path(name, level)
        schema = self._schema(spec, path)
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def load(
        self, name: str, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None
    ) -> DataFrame:
        """Inclusive time range of a dataset; both bounds also prune partitions."""
        spec = dataset(name)
        frame = self.scan(name)
        derived = spec.partition not in spec.columns
        others = [c for c in frame.columns if c not in spec.columns and not (derived and c == spec.partition)]
        kept = spec.columns + (others if spec.open_schema else [])
        wanted = list(columns) if columns else kept
        time = F.col(spec.temporal)
        day = S.iso_week_monday(time) if spec.temporal == "week" else time
        for bound, later in ((start, True), (end, False)):
            if bound is None:
                continue
            limit = F.lit(bound).cast("date")
            frame = frame.where(day >= limit if later else day <= limit)
            if derived and spec.partition in frame.columns:
                frame = frame.where(self._partition_bound(spec, limit, later))
        return frame.select(*wanted)

    @staticmethod
    def _partition_bound(spec: DatasetSpec, limit: Column, later: bool) -> Column:
        """The same bound on a derived partition column, widened to its own period."""
        first = S.partition_day(F.col(spec.partition), spec.partition)
        if not later:
            return first <= limit
        last = {"week": F.date_add(first, 6), "month": F.last_day(first)}.get(spec.partition, first)
        return last >= limit

    def sorted(self, frame: DataFrame, name: str) -> DataFrame:
        """Output order: temporal column, then primary key."""
        spec = dataset(name)
        order = dict.fromkeys(c for c in (spec.temporal, *spec.primary_key) if c in frame.columns)
        return frame.orderBy(*order)

    def view(self, name: str, level: str, view: str | None = None) -> str:
        """One temporary view over all partitions; old level names are accepted."""
        label = view or f"{level_name(level)}_{name}"
        self.scan(name, level).createOrReplaceTempView(label)
        return label

    def read_keys(self, name: str, keys: DataFrame | Sequence, level: str | None = None) -> DataFrame:
        """Rows of the given partitions; keys without data are ignored and no other partition is read.

        Unless most partitions are asked for, the others' folders are not even listed.
        """
        spec, path = dataset(name), self.path(name, level)
        if isinstance(keys, DataFrame):
            keys = self.stored_keys(name, keys, level)
        keys = {str(k) for k in keys}
        held = self.folders(name, level)
        asked = sorted(k for k in keys if k in held)
        if 2 * len(asked) > len(held) or spec.open_schema:
            typed = [dt.date.fromisoformat(k) if spec.partition == "dt" else k for k in asked]
            return self.scan(name, level).where(F.col(spec.partition).isin(typed))
        schema = self._schema(spec, path)
        if not asked:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{spec.partition}={k}" for k in asked])

    def folders(self, name: str, level: str | None = None) -> set[str]:
        """Keys of the stored partitions, from one listing of folder names."""
        return self.folders_below(self.path(name, level).removeprefix(f"{self.root}/"), dataset(name).partition)

    def folders_below(self, path: str, column: str) -> set[str]:
        """Keys of the folders `column=key` below a path of the lake."""
        path = f"{self.root}/{path}"
        if not path_exists(self.spark, path):
            return set()
        fs, where = file_system(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
        return {n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")}

    def stored_keys(self, name: str, keys: DataFrame, level: str | None = None) -> list[str]:
        """Those of the keys that have a partition: at most one name per folder, which the driver lists anyhow."""
        held = self.folders(name, level)
        asked = keys.select(F.col(dataset(name).partition).cast("string").alias("key")).distinct()
        known = self.spark.createDataFrame([(k,) for k in held], "key string")
        return sorted(r["key"] for r in asked.join(known, "key", "left_semi").collect()) if held else []

    # --- writing ----------------------------------------------------------------------

    def _prepared(self, spec: DatasetSpec, frame: DataFrame) -> DataFrame:
        quality.require_columns(frame.drop(spec.partition) if spec.partition not in spec.columns else frame,
                                spec, reject_extra=True)
        typed = strict_types(frame, spec.kinds)
        if spec.partition in spec.columns:
            return typed
        key = partition_column(spec.partition, F.col(spec.temporal))
        return typed.withColumn(spec.partition, key.cast("date") if spec.partition == "dt" else key)

    def replace(self, name: str, frame: DataFrame, level: str | None = None) -> None:
        """Swap every partition present in the frame for the frame's rows.

        The rebalance hint spreads rows by partition and splits an oversized
        partition over several tasks, so a hot day or week is not one task.
        """
        spec = dataset(name)
        rows = self._prepared(spec, frame)
        with every_shuffle_partition(self.spark):
            (
                rows.hint("rebalance", spec.partition)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(spec.partition)
                .parquet(self.path(name, level))
            )

    def swap(self, name: str, reached: DataFrame, rows: DataFrame, level: str | None = None) -> None:
        """Swap the rows of the reached keys for `rows`; a reached key without a row goes. `reached` has the partition
        column and other columns of the dataset. Other rows of the touched partitions stay as they are."""
        spec = dataset(name)
        new = stored(self._prepared(spec, rows), f"swapped-{name}")
        held = self.read_keys(name, reached, level).join(reached, reached.columns, "left_anti")
        out = stored(held.select(*new.columns).unionByName(new), f"merged-{name}")
        self.replace(name, out, level)
        emptied = set(self.stored_keys(name, reached, level)) - {str(r[0]) for r in out.select(spec.partition).distinct().collect()}
        fs, where = file_system(self.spark, self.path(name, level))
        for key in emptied:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{spec.partition}={key}"), True)

    def merged(self, name: str, frame: DataFrame, level: str | None = None) -> DataFrame:
        """Touched partitions after an upsert: old rows without a new version, plus the new."""
        spec = dataset(name)
        new = self._prepared(spec, frame)
        if not path_exists(self.spark, self.path(name, level)):
            return new
        old = self.read_keys(name, new.select(spec.partition), level)
        kept = old.join(new.select(*spec.primary_key), list(spec.primary_key), "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)

    def upsert(self, name: str, frame: DataFrame, level: str | None = None) -> None:
        """Keyed upsert: a row replaces the stored row with the same primary key.

        The typed rows are stored once and the touched partitions are merged in the shared
        folder, so no partition is replaced while it is still being read.
        """
        spec = dataset(name)
        new = stored(self._prepared(spec, frame), f"incoming-{name}")
        repeated = quality.duplicate_keys(new, spec.primary_key).limit(1).count()
        if repeated:
            raise quality.ValidationError(f"primary key {spec.primary_key} repeats in {name}")
        if path_exists(self.spark, self.path(name, level)):
            new = stored(self.merged(name, new, level), f"merged-{name}")
        self.replace(name, new, level)

    def land(self, name: str, raw: DataFrame, ingest_date: str, batch: str | None = None) -> str:
        """Raw snapshot below bronze, one partition per ingest date (and batch, where one is given)."""
        path = f"{self.root}/bronze/{name}"
        stamped = raw.withColumn("ingest_date", F.lit(ingest_date).cast("date"))
        keys = ["ingest_date"]
        if batch is not None:
            stamped, keys = stamped.withColumn("batch", F.lit(batch)), [*keys, "batch"]
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        return path

    # --- partitions -------------------------------------------------------------------

    def partitions(self, name: str, level: str | None = None) -> DataFrame:
        """(partition, key, day) of every stored partition, from directory names."""
        path = self.path(name, level)
        schema = "partition string, key string"
        if not path_exists(self.spark, path):
            found = []
        else:
            fs, where = file_system(self.spark, path)
            names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
            found = [(n, n.split("=", 1)[1]) for n in names if "=" in n]
        frame = self.spark.createDataFrame(found, schema)
        kind = F.substring_index("partition", "=", 1)
        day = (
            F.when(kind == "week", S.iso_week_monday(F.col("key")))
            .when(kind == "month", F.concat("key", F.lit("-01")).cast("date"))
            .otherwise(F.col("key").try_cast("date"))
        )
        return frame.withColumn("day", day)

    def latest(self, name: str, level: str | None = None) -> str | None:
        return self.partitions(name, level).agg(F.max_by("partition", "day")).first()[0]

    def prune(
        self, name: str, level: str, older_than: str | None = None, keep_last: int | None = None,
        force: bool = False, today: dt.date | None = None,
    ) -> list[str]:
        """Delete expired partitions; gold needs `force`."""
        if level_name(level) == "gold" and not force:
            raise ValueError("pruning gold needs force=True")
        cutoff = retention_cutoff(older_than, today or dt.date.today()) if older_than else None
        names = [r["partition"] for r in expired(self.partitions(name, level), cutoff, keep_last).collect()]
        fs, where = file_system(self.spark, self.path(name, level))
        for partition in names:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, partition), True)
        return sorted(names)
