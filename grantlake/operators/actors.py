"""Who acts when a frame does not say: an ambient actor, an ambient bypass."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TYPE_CHECKING

from ..errors import UnscopedNotAllowed
from ..refs import SubjectRef, agent_grant

if TYPE_CHECKING:
    from .engine import Engine

_ACTOR: ContextVar[SubjectRef | None] = ContextVar("actor", default=None)
_BYPASS: ContextVar[str | None] = ContextVar("bypass", default=None)


def current_actor() -> SubjectRef | None:
    return _ACTOR.get()


def current_bypass() -> str | None:
    return _BYPASS.get()


@contextmanager
def acting(actor: SubjectRef | str) -> Iterator[SubjectRef]:
    """Frames without an actor of their own act as this one."""
    ref = actor if isinstance(actor, SubjectRef) else SubjectRef.parse(actor)
    mark = _ACTOR.set(ref)
    try:
        yield ref
    finally:
        _ACTOR.reset(mark)


@contextmanager
def acting_agent(user_id, agent_id) -> Iterator[SubjectRef]:
    """As acting(), for an agent that a user let act."""
    with acting(agent_grant(str(user_id), str(agent_id))) as ref:
        yield ref


@contextmanager
def bypassing(engine: Engine, reason: str, system: bool = False) -> Iterator[None]:
    """Frames without an actor of their own are unscoped. Needs what unscoped() needs, unless for the engine's own work (system); leaves an audit row."""
    if not system:
        allow_bypass(engine, reason)
    if engine.trail:
        engine.trail.bypass(current_actor(), reason)
    mark = _BYPASS.set(reason or "-")
    try:
        yield
    finally:
        _BYPASS.reset(mark)


def allow_bypass(engine: Engine, reason: str) -> None:
    if not engine.config.allow_unscoped:
        raise UnscopedNotAllowed("the configuration forbids unscoped frames")
    if engine.config.unscoped_needs_reason and not reason:
        raise UnscopedNotAllowed("unscoped frames need a reason")
