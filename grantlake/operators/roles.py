"""Role edges: who is in a role, what a role implies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..refs import Grant, ObjectRef, SubjectRef
from ..sources.store import TupleStore

MEMBER, INCLUDES, EFFECTIVE = "member", "includes", "effective_member"


def is_role():
    """Role objects are those whose type ends in /role."""
    return F.col("resource_type").endswith("/role")


def roles_of(store: TupleStore, subjects: DataFrame) -> DataFrame:
    """(subject..., role_type, role_id) of direct membership."""
    keys = ["subject_type", "subject_id", "subject_relation"]
    edges = store.df.where(is_role() & (F.col("relation") == MEMBER))
    return edges.join(subjects.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("resource_type").alias("role_type"), F.col("resource_id").alias("role_id")).distinct()


def members_of(store: TupleStore, role: ObjectRef) -> DataFrame:
    return store.for_resource(role.type, role.id).where(F.col("relation") == MEMBER).select("subject_type", "subject_id", "subject_relation").distinct()


def implies_of(store: TupleStore, role: ObjectRef) -> DataFrame:
    """(role_type, role_id) of roles that members of `role` also hold."""
    edges = store.for_subject(role.type, role.id, EFFECTIVE).where(is_role() & (F.col("relation") == INCLUDES))
    return edges.select(F.col("resource_type").alias("role_type"), F.col("resource_id").alias("role_id")).distinct()


def implied_by_of(store: TupleStore, role: ObjectRef) -> DataFrame:
    """(role_type, role_id) of roles whose members hold `role` too."""
    edges = store.for_resource(role.type, role.id).where((F.col("relation") == INCLUDES) & (F.col("subject_relation") == EFFECTIVE))
    return edges.select(F.col("subject_type").alias("role_type"), F.col("subject_id").alias("role_id")).distinct()


def member_grant(role: ObjectRef, subject: SubjectRef) -> Grant:
    return Grant(role, MEMBER, subject)


def imply_grant(role: ObjectRef, implied: ObjectRef) -> Grant:
    """Members of role also hold implied."""
    return Grant(implied, INCLUDES, SubjectRef(role.type, role.id, EFFECTIVE))


def grant_role(store: TupleStore, schema, role: ObjectRef, subject: SubjectRef) -> TupleStore:
    return store.write(schema, [member_grant(role, subject)])[0]


def imply(store: TupleStore, schema, role: ObjectRef, implied: ObjectRef) -> TupleStore:
    return store.write(schema, [imply_grant(role, implied)])[0]


def revoke_role(store: TupleStore, role: ObjectRef, subject: SubjectRef) -> TupleStore:
    return store.delete(resource_type=role.type, resource_id=role.id, relation=MEMBER, subject_type=subject.type, subject_id=subject.id)


def unimply(store: TupleStore, role: ObjectRef, implied: ObjectRef) -> TupleStore:
    return store.delete(resource_type=implied.type, resource_id=implied.id, relation=INCLUDES, subject_type=role.type, subject_id=role.id, subject_relation=EFFECTIVE)
