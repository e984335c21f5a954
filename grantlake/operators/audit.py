"""The audit trail of writes: an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import target_column
from .actors import current_actor

SCHEMA = "kind string, actor_type string, actor_id string, target string, before string, after string, reason string, occurred_at timestamp"


def events(tuples: DataFrame, kind: str, actor: tuple[str, str] = ("", ""), reason: str = "", at: str | None = None) -> DataFrame:
    """A row a tuple: kind is grant, revoke or bypass; the tuple as JSON stands before (revoke) or after (grant)."""
    body = F.to_json(F.struct(*tuples.columns))
    none = F.lit(None).cast("string")
    return tuples.select(
        F.lit(kind).alias("kind"),
        F.lit(actor[0]).alias("actor_type"),
        F.lit(actor[1]).alias("actor_id"),
        target_column().alias("target"),
        (body if kind == "revoke" else none).alias("before"),
        (body if kind == "grant" else none).alias("after"),
        F.lit(reason).alias("reason"),
        (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("occurred_at"),
    )


def denials(checked: DataFrame, at: str | None = None) -> DataFrame:
    """Audit rows of the checks that did not allow."""
    target = F.concat("resource_type", F.lit(":"), "resource_id", F.lit("#"), "action")
    no = checked.where(~F.col("allowed"))
    none = F.lit(None).cast("string")
    return no.select(F.lit("deny").alias("kind"), F.col("subject_type").alias("actor_type"), F.col("subject_id").alias("actor_id"), target.alias("target"), none.alias("before"), none.alias("after"), F.col("reason"), (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("occurred_at"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


class Trail:
    """The audit trail in a folder. Stores note grants and revokes in it, engines denials (if the configuration says so), frames bypasses."""

    def __init__(self, spark, path: str, actor: tuple[str, str] = ("", ""), reason: str = "", at: str | None = None):
        self.spark, self.path, self.actor, self.reason, self.at = spark, path, actor, reason, at

    def by(self, actor: tuple[str, str], reason: str = "") -> Trail:
        """The same folder, for another actor."""
        return Trail(self.spark, self.path, actor, reason, self.at)

    def granted(self, tuples: DataFrame) -> None:
        append(events(tuples, "grant", self._who(), self.reason, self.at), self.path)

    def revoked(self, tuples: DataFrame) -> None:
        append(events(tuples, "revoke", self._who(), self.reason, self.at), self.path)

    def denied(self, checked: DataFrame) -> None:
        append(denials(checked, self.at), self.path)

    def bypass(self, actor, reason: str) -> None:
        who = (actor.type, actor.id) if actor else self._who()
        row = self.spark.createDataFrame([("bypass", *who, "", reason)], "kind string, actor_type string, actor_id string, target string, reason string")
        none = F.lit(None).cast("string")
        append(row.select("kind", "actor_type", "actor_id", "target", none.alias("before"), none.alias("after"), "reason", (F.lit(self.at).cast("timestamp") if self.at else F.current_timestamp()).alias("occurred_at")), self.path)

    def _who(self) -> tuple[str, str]:
        ref = current_actor()
        return (ref.type, ref.id) if ref and not any(self.actor) else self.actor

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)
