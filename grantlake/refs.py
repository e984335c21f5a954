"""References to objects and subjects, and their text forms."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class ObjectRef:
    """`type:id`. The id begins after the first colon and may hold more."""

    type: str
    id: str = ""

    @classmethod
    def parse(cls, text: str) -> ObjectRef:
        kind, colon, rest = text.partition(":")
        if not colon or not kind:
            raise ValueError(f"not type:id: {text!r}")
        return cls(kind, rest)

    def __str__(self) -> str:
        return f"{self.type}:{self.id}"


@dataclass(frozen=True, order=True)
class SubjectRef:
    """`type:id`, or `type:id#relation` for everyone who has relation on the object."""

    type: str
    id: str
    relation: str = ""

    @classmethod
    def parse(cls, text: str) -> SubjectRef:
        body, _, relation = text.partition("#")
        obj = ObjectRef.parse(body)
        return cls(obj.type, obj.id, relation)

    def __str__(self) -> str:
        return f"{self.type}:{self.id}" + (f"#{self.relation}" if self.relation else "")


@dataclass(frozen=True)
class Grant:
    """One relationship tuple."""

    resource: ObjectRef
    relation: str
    subject: SubjectRef
    caveat: str = ""
    context: str | None = None
    expires_at: str | None = None


def agent_grant(user_id: str, agent_id: str) -> SubjectRef:
    """The subject of an agent that acts for a user."""
    return SubjectRef("agents/grant", f"{user_id}.{agent_id}", "valid")


def subject_ref(config, kind: str, ident) -> SubjectRef:
    """An entity as a subject: a group stands for its members, as the configuration names groups, anything else for itself."""
    return SubjectRef(kind, str(ident), "member" if kind == config.group_type else "")
