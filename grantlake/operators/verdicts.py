"""Sets of verdicts and their algebra, in Kleene's three-valued logic.

A verdict is a TINYINT: 2 yes, 1 conditional, 0 no. OR is the greater, AND the lesser, A BUT NOT B the
lesser of A and 2 - B. Rows that are absent are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or3(*v: Column) -> Column:
    return F.greatest(*v)


def and3(*v: Column) -> Column:
    return F.least(*v)


def minus3(a: Column, b: Column) -> Column:
    return F.least(a, (F.lit(2) - b).cast("tinyint"))


@dataclass(frozen=True)
class Verdicts:
    """rows: (skey, rid, v[, m]). whole: (skey, v[, m]) of subjects whose verdict holds for every object of the type. None is empty.

    m: the names of missing caveat parameters, carried only where a reachable tuple has a caveat.
    """

    rows: DataFrame | None = None
    whole: DataFrame | None = None


def _names(*pairs: tuple[Column, Column]) -> Column:
    """Names from the conditional ones of (v, m)."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.when(v == 1, F.coalesce(m, none)).otherwise(none) for v, m in pairs])))


class Algebra:
    """Operations on Verdicts; conditional says whether missing names are carried."""

    def __init__(self, conditional: bool):
        self.conditional = conditional
        self.extra = ["m"] if conditional else []

    def merge(self, df: DataFrame | None, *keys: str, also: tuple[Column, ...] = ()) -> DataFrame | None:
        """One row a key: the greatest verdict, with the names of all derivations if it is conditional; also: more aggregates."""
        if df is None:
            return None
        if not self.conditional:
            return df.groupBy(*keys).agg(F.max("v").alias("v"), *also)
        out = df.groupBy(*keys).agg(F.max("v").alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("v") == 1, F.col("m")))))).alias("m"), *also)
        return out.withColumn("m", F.when(F.col("v") == 1, F.col("m")).otherwise(F.array().cast("array<string>")))

    def stack(self, *dfs: DataFrame | None) -> DataFrame | None:
        out = None
        for df in dfs:
            out = df if out is None else out if df is None else out.unionByName(df)
        return out

    def union(self, *parts: Verdicts) -> Verdicts:
        rows, whole = [p.rows for p in parts if p.rows is not None], [p.whole for p in parts if p.whole is not None]
        many = lambda dfs, *k: self.merge(self.stack(*dfs), *k) if len(dfs) > 1 else dfs[0] if dfs else None
        return Verdicts(many(rows, "skey", "rid"), many(whole, "skey"))

    def _meet(self, a: DataFrame | None, b: DataFrame | None, on: list[str], keys: list[str]) -> DataFrame | None:
        if a is None or b is None:
            return None
        x, y = a.alias("x"), b.alias("y")
        j = x.join(y, on)
        v = and3(F.col("x.v"), F.col("y.v")).alias("v")
        m = [_names((F.col("x.v"), F.col("x.m")), (F.col("y.v"), F.col("y.m"))).alias("m")] if self.conditional else []
        return j.select(*keys, v, *m)

    def intersection(self, a: Verdicts, b: Verdicts) -> Verdicts:
        keys = ["skey", "rid"]
        parts = [self._meet(a.rows, b.rows, keys, keys), self._meet(a.rows, b.whole, ["skey"], keys), self._meet(b.rows, a.whole, ["skey"], keys)]
        parts = [p for p in parts if p is not None]
        rows = self.merge(self.stack(*parts), *keys) if len(parts) > 1 else parts[0] if parts else None
        return Verdicts(rows, self._meet(a.whole, b.whole, ["skey"], ["skey"]))

    def _less(self, a: DataFrame, b: DataFrame | None, on: list[str], keys: list[str]) -> DataFrame:
        if b is None:
            return a
        if not self.conditional:
            return a.join(b.where("v = 2"), on, "left_anti")
        x, y = a.alias("x"), b.alias("y")
        other = F.coalesce(F.col("y.v"), F.lit(0).cast("tinyint"))
        v = minus3(F.col("x.v"), other)
        return x.join(y, on, "left").select(*[F.col(f"x.{k}").alias(k) for k in keys], v.alias("v"), F.when(v == 1, _names((F.col("x.v"), F.col("x.m")), (other, F.col("y.m")))).otherwise(F.array().cast("array<string>")).alias("m")).where("v > 0")

    def exclusion(self, a: Verdicts, b: Verdicts, everything) -> Verdicts:
        """everything() lists the type's ids; it is only called where someone has the whole type but for some rows."""
        keys = ["skey", "rid"]
        rows, whole = a.rows, a.whole
        if whole is not None and b.rows is not None:
            rows = self.merge(self.stack(rows, self.spread(whole, everything())), *keys)
            whole = None
        if rows is not None:
            rows = self._less(self._less(rows, b.rows, keys, keys), b.whole, ["skey"], keys)
        if whole is not None:
            whole = self._less(whole, b.whole, ["skey"], ["skey"])
        return Verdicts(rows, whole)

    def spread(self, whole: DataFrame, ids: DataFrame) -> DataFrame:
        """whole as rows over ids: the answer itself is that large. whole has a row a requested subject."""
        return product(ids, "rid", whole).select("skey", "rid", "v", *self.extra)


#: Parts that the larger side of a product is dealt to.
PARTS = 32
#: Subjects that are a row of a product of blocks, or so, and objects.
BLOCK, OBJECTS = 1 << 8, 1 << 7
#: Rows of an answer that are a task's share, or so, up to 4 * PARTS tasks.
SHARE = 1 << 22


def product(large: DataFrame, by: str, small: DataFrame, few: bool = False) -> DataFrame:
    """Every row of large with every row of small, where the answer is that large: an ordinary join on a part number, which a hash of `by` deals
    large to and which small holds all of. No task gets all of large, and Spark sends small to all if it is small enough (or few says so)."""
    dealt = large.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(F.broadcast(copies) if few else copies, "_part").drop("_part")


def tasks(rows: int) -> int:
    """Among how many tasks an answer of so many rows is dealt."""
    return min(4 * PARTS, 1 + rows // SHARE)


def every_pair(objects: DataFrame, n: int, subjects: DataFrame, m: int, by: str) -> DataFrame:
    """Every object (rid, once each, n of them at most) with every one of m subjects, which are sent to all executors: rid and the columns of subjects. by: a column that tells subjects apart.

    A task takes a block of subjects after the other for some objects at a time. What is written then repeats the same few subjects for one object
    after the other, which compresses well: all subjects in turn for each object would be farther apart than a codec looks back.
    """
    deal = lambda column, of: F.pmod(F.xxhash64(column), F.lit(of))
    some = objects.withColumn("_some", deal("rid", 1 + n // OBJECTS)).groupBy("_some").agg(F.collect_list("rid").alias("rids")).repartition(tasks(n * m), "_some")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m // BLOCK).cast("long"))).alias("_block")
    rows = some.select("rids", block).select("_block", F.explode("rids").alias("rid"))
    return rows.join(F.broadcast(subjects.withColumn("_block", deal(by, 1 + m // BLOCK))), "_block").drop("_block")
