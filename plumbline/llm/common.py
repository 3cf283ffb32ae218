"""What the corpus operators share: the shared folder, tables that cut lineage, batches of whole texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters' complement, as byte values: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: A word, for Java's regular expressions.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, one is made and named, on one machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor costs one re-read.

    group: bytes after which a row group ends, for rows of many values. Writers hold a row group whole, readers up to 4096
    rows of one, and neither looks at its size before the hundredth row unless told to.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    how = {} if group is None else {"parquet.block.size": group, "parquet.page.size.row.check.min": 1}
    df.write.options(**how).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that no later plan reads."""
    _delete(df.sparkSession, df.written_to)


def forget_all(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that read them must have been used before."""
    _delete(spark, _own_dir(spark))


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def with_columns(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list]]:
    """(ids, values) of two-column batches, a bounded number of rows at a time, so that lists stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


#: A group of over one in so many of all rows is large; there are fewer large groups than that.
LARGE = 10_000


def join_uneven(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, by: str) -> DataFrame:
    """rows left-joined to groups by keys that groups have once, where any share of the rows may belong to one group.

    size names the column of groups with the number of their rows, total is that of all rows. Groups of over
    total / LARGE rows are fewer than LARGE and are sent to every task; the others are joined by a shuffle, in which
    rows of large groups are dealt out by the column by. Columns of groups, but keys and size, are added to rows.
    """
    names = [c for c in groups.columns if c not in keys and c != size]
    large = F.col(size) * LARGE > total
    sent = groups.where(large).select(*keys, F.struct(*names).alias("_sent"))
    other = groups.where(~large).select(*keys, F.lit(0).cast("long").alias("_spread"), F.struct(*names).alias("_met"))
    spread = F.when(F.col("_sent").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(by), F.lit(1 << 30)))
    found = rows.join(F.broadcast(sent), keys, "left").withColumn("_spread", spread).join(other, [*keys, "_spread"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col("_sent")[c], F.col("_met")[c]).alias(c) for c in names])
