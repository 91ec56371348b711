"""Shared helpers: table reading, written cut points, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from stratalens.joins import hot_keys, spread_join
from stratalens.storage import cut, shared_dir

__all__ = ["bounded_batches", "cut", "filter_texts", "hash_sample", "hot_keys", "map_rows", "shared_dir", "spread_join", "table"]

BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most `n` distinct rows of the columns, those with the least hashes.

    Hashes alone are sorted first, so tasks send numbers, not texts or vectors, until the
    rows are known.
    """
    marked = df.select(*columns, F.xxhash64(*columns).alias("__h"))
    least = marked.select("__h").distinct().orderBy("__h").limit(n)
    return marked.join(F.broadcast(least), "__h", "left_semi").dropDuplicates(["__h"]).orderBy("__h").select(*columns)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch, so that long texts do not pile up in a worker.

    A plan reads this setting when it runs, so it stays lowered; a user's lower value is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow with state per task: `start()` gives a function from a batch to columns by name."""
    bounded_batches(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                got = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_texts(df: DataFrame, start: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """Rows of `df`, all columns, whose text is kept: `start()` gives a function from texts to booleans.

    One pass without a join or shuffle: rows go through the worker and back.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(step(batch.column(batch.schema.get_field_index(text_col)).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
