"""What the operators of this subpackage share: words, scratch tables, skew-proof running sums."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import delete, own_root

#: A word is a run of anything but ASCII white space (Java and RE2 syntax alike).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often (or in whatever lambda) body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only: other letters stay, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


#: Rows of an Arrow batch that a Python worker turns into objects at a time.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices: a worker's memory is that of a batch's buffers and of a slice's objects."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def give_back() -> None:
    """Hands free memory back to the system, where the C library can: else what a driver has once worked with stays counted as its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def packed(docs: DataFrame) -> Column:
    """The row of docs as one struct, whose fields no name beside it can clash with."""
    return F.struct(*[docs[quoted(c)].alias(c) for c in docs.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields(docs: DataFrame, row: str = "row", but: Iterable[str] = ()) -> list[Column]:
    """The columns of docs back from the struct, without those that have a name of `but`, in whatever case."""
    gone = {c.lower() for c in but}
    return [F.col(row)[c].alias(c) for c in docs.columns if c.lower() not in gone]


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores appended where a column has one already, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


class Scratch:
    """Tables in the shared folder. Writing one cuts the lineage: a lost executor costs its own tasks only, since what was written stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{own_root(spark)}/scratch-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str, sums: DataFrame | None = None) -> DataFrame:
    """df with out: the sum of value over the rows of the same keys that come before, in order.

    sums: those of value by keys and bucket as _sum, if they are known already.

    bucket must rise with the order and split every key into even parts (say, the first digits of a
    hash that leads the order). No task then holds a key: sums by (key, bucket) are added up first, a
    few rows a key, and rows are summed within (key, bucket). Rows that tie in order may change places.
    """
    cols = df.columns
    part = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum")) if sums is None else sums
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(part, [*keys, bucket]).select(*cols, (F.col("_before") + F.col("_inner")).cast("long").alias(out))
