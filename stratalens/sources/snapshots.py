"""A store of snapshots: each is written aside, then named by a manifest, so a failed write changes nothing for readers.

    <root>/data/<name>-<id>/<table>/       the rows, as JSON lines
    <root>/manifest/<name>-<id>/           one row: name, place, tables, order; written when all tables are

The newest manifest is the current snapshot.  Pruning takes the manifest away first, so a reader never
meets a snapshot that is half deleted; one that has begun to read fails, and reads again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, place string, tables array<string>, seq long"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_snapshot(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> str:
    """Write the tables as a snapshot; gives its place below the root.  An empty table is kept."""
    place = f"{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.json(f"{root}/data/{place}/{table}")
    row = [(name, place, sorted(tables), time.time_ns())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{root}/manifest/{place}")
    return place


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """name, place, tables, seq of the whole snapshots of a store, a small table; none if there is no store yet."""
    fs, path = _path(spark, f"{root}/manifest")
    # a manifest whose writer has not ended has no mark of success
    done = [x.getPath().toString() for x in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if fs.exists(path) else []
    return spark.read.schema(MANIFEST).json(done) if done else spark.createDataFrame([], MANIFEST)


def read_snapshot(spark: SparkSession, root: str, table: str, schema: str, name: str | None = None) -> DataFrame:
    """Rows of a table of the newest snapshot, or of the newest of a name; an error if there is none."""
    every = snapshots(spark, root)
    found = (every if name is None else every.where(F.col("name") == name)).orderBy(F.desc("seq")).first()
    if found is None or table not in found["tables"]:
        raise LookupError(f"no snapshot {name or ''} with a table {table} below {root}")
    return spark.read.schema(schema).json(f"{root}/data/{found['place']}/{table}")


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all but the `keep` newest snapshots, and tables of writes that never ended; gives the places deleted.

    For stores without another writer at work.
    """
    kept = {r["place"] for r in snapshots(spark, root).orderBy(F.desc("seq")).limit(keep).collect()}
    gone = []
    for folder in ("manifest", "data"):
        fs, path = _path(spark, f"{root}/{folder}")
        for x in fs.listStatus(path) if fs.exists(path) else []:
            place = x.getPath().getName()
            if place not in kept:
                fs.delete(x.getPath(), True)
                gone.append(place)
    return sorted(set(gone))


def with_stale(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of `now` and, marked in `stale`, those of `before` whose key is gone; both have the same columns."""
    gone = before.join(now.select(key).distinct(), key, "left_anti").select(*now.columns)
    return now.withColumn("stale", F.lit(False)).unionAll(gone.withColumn("stale", F.lit(True)))
