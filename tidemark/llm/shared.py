"""Where jobs keep tables that they read more than once."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import shared_folder


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs a re-read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that are worked on at a time, which bounds the copies of texts in a Python worker.
ROWS = 1_000


def added(df: DataFrame, factory, columns: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns that Python computes from Arrow batches, without a shuffle.

    factory() is called once per task and gives a function from a record batch to {name: array}. Columns of
    df that are to be dropped or that have the name of a new one are left out.
    """
    kept = [f for f in df.schema.fields if f.name not in columns and f.name not in drop]
    new = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    names = [f.name for f in kept] + list(columns)

    def run(batches):
        make = factory()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = make(batch)
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [made[c] for c in columns], names)

    return df.mapInArrow(run, StructType(kept + new.fields))
