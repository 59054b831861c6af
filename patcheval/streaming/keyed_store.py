"""A table with one row per key that batches change.

Rows lie in hash buckets of their key. A batch writes anew only the buckets that it touches, in a folder of its version, and then a
manifest that says for every bucket which version holds it. The manifest is the commit: a batch that fails before it leaves the table as
it was, and one that is repeated after it changes nothing. :func:`compact` removes what the newest manifests do not name.
One job writes at a time; any number may read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patcheval.functions.stage import remove, written

_MANIFEST = "bucket int, held_by bigint, buckets int, source string, batch bigint, seen bigint, schema string"
#: The manifest row that carries the settings where no bucket has rows.
_NONE = -1


@dataclass(frozen=True)
class Version:
    """A committed state: which version holds each bucket that has rows, and the batch that made it. ``seen`` is a number that the
    writer hands on to the next batch, such as the greatest event time."""

    number: int
    held_by: dict[int, int]
    buckets: int
    source: str
    batch: int
    seen: int | None
    schema: str


def _list(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all manifests that are written whole, newest first."""
    numbers = sorted((int(n.split("=")[1]) for n in _list(spark, f"{path}/manifest") if n.startswith("version=")), reverse=True)
    return [n for n in numbers if _exists(spark, f"{path}/manifest/version={n}/_SUCCESS")]


def _version(spark: SparkSession, path: str, number: int) -> Version:
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={number}").collect()
    one = rows[0]
    return Version(number, {r.bucket: r.held_by for r in rows if r.bucket != _NONE}, one.buckets, one.source, one.batch, one.seen, one.schema)


def newest(spark: SparkSession, path: str) -> Version | None:
    """The state that counts, or None where nothing was committed. A row per bucket comes to the driver."""
    numbers = _committed(spark, path)
    return _version(spark, path, numbers[0]) if numbers else None


def is_done(version: Version | None, source: str, batch: int) -> bool:
    """Whether the batch of that source is the one committed last."""
    return version is not None and (version.source, version.batch) == (source, batch)


def _paths(path: str, version: Version, buckets) -> list[str]:
    return [f"{path}/data/version={version.held_by[b]}/_bucket={b}" for b in sorted(buckets) if b in version.held_by]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest state. Empty where no batch had rows; an error where nothing was committed."""
    version = newest(spark, path)
    if version is None:
        raise ValueError(f"no version was committed in {path}")
    schema = StructType.fromJson(json.loads(version.schema))
    paths = _paths(path, version, version.held_by)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def last_rows(keys) -> Callable[[DataFrame], DataFrame]:
    """The new row of a key replaces the old one; of several new ones the greatest counts."""

    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "_new")]
        last = F.max(F.struct("_new", *rest)).alias("_last")
        return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])

    return combine


def upsert(
    batch: DataFrame, path: str, keys, source: str = "", number: int = 0, combine: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = 64, seen: int | None = None, keep: int | None = 2,
) -> None:
    """Brings the rows of a batch into the table at ``path`` and commits a new version.

    ``combine`` gets the old and new rows of the touched buckets, told apart by the boolean ``_new``, and gives one row per key;
    without it :func:`last_rows`. ``source`` and ``number`` name the batch: given again, it changes nothing. ``buckets`` counts
    when the table is made, later its own number does. Null keys are keys. ``keep`` newest states stay readable (None: all).
    """
    spark = batch.sparkSession
    before = newest(spark, path)
    if is_done(before, source, number):
        return
    version = before.number + 1 if before else 1
    buckets = before.buckets if before else buckets
    keys = list(keys)
    combine = combine or last_rows(keys)
    # rows of one key that come several times in a batch meet here, merged map-side
    new = combine(batch.withColumn("_new", F.lit(True)))
    schema = new.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    held, target = dict(before.held_by) if before else {}, f"{path}/data/version={version}"
    folder, touched = None, []
    if not held:
        # nothing to bring it together with: the batch is the state
        new.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(target)
        held = {int(n.split("=")[1]): version for n in _list(spark, target) if n.startswith("_bucket=")}
    else:
        new, folder = written(new.withColumn("_bucket", bucket), "upsert")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
    if touched:
        merged = new.drop("_bucket")
        old = _paths(path, before, touched) if before else []
        if old:
            rows = spark.read.schema(schema).parquet(*old).withColumn("_new", F.lit(False))
            merged = combine(rows.unionByName(merged.withColumn("_new", F.lit(True))))
        out = merged.withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
        out.write.mode("overwrite").partitionBy("_bucket").parquet(target)
        held.update({b: version for b in touched})
    if folder:
        remove(spark, folder)
    settings = (buckets, source, number, seen, schema.json())
    rows = [(b, v, *settings) for b, v in sorted(held.items())] or [(_NONE, 0, *settings)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    if keep is not None:
        compact(spark, path, keep)


def compact(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the ``keep`` newest manifests and the buckets that none of these names; returns how many folders went.
    A job that still reads an older state loses it, so keep as many as readers need."""
    numbers = _committed(spark, path)
    if len(numbers) <= 1:
        return 0
    kept = [_version(spark, path, n) for n in numbers[: max(keep, 1)]]
    for n in numbers[max(keep, 1) :]:
        remove(spark, f"{path}/manifest/version={n}")
    named = {(v, b) for state in kept for b, v in state.held_by.items()}
    gone = 0
    for folder in _list(spark, f"{path}/data"):
        v = int(folder.split("=")[1])
        if v > kept[0].number:
            continue
        here = [n for n in _list(spark, f"{path}/data/{folder}") if n.startswith("_bucket=")]
        dead = [n for n in here if (v, int(n.split("=")[1])) not in named]
        if len(dead) == len(here):
            remove(spark, f"{path}/data/{folder}")
        else:
            for n in dead:
                remove(spark, f"{path}/data/{folder}/{n}")
        gone += len(dead)
    return gone
