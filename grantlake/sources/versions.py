"""Version tokens: what a write returns and what a read may ask to have seen."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

BACKEND = "lake"
_TOKEN: ContextVar[list[str | None] | None] = ContextVar("token", default=None)


def token(version: int) -> str:
    return f"{BACKEND}.{version}"


def read_token(text: str) -> int:
    """The version in a token of this backend."""
    backend, _, number = text.partition(".")
    if backend != BACKEND or not (number.isascii() and number.isdigit()):
        raise ValueError(f"not a token of this store: {text!r}")
    return int(number)


@contextmanager
def version_scope(initial: str | None = None) -> Iterator[None]:
    """Within it, writes leave their token, and reads that ask for nothing else must have seen it."""
    mark = _TOKEN.set([initial])
    try:
        yield
    finally:
        _TOKEN.reset(mark)


def record_version(made: str | None) -> None:
    """Notes a write's token, if it is later; nothing outside a scope, so nothing leaks from one piece of work into the next."""
    held = _TOKEN.get()
    if held is not None and made is not None and (held[0] is None or read_token(made) > read_token(held[0])):
        held[0] = made


def current_version() -> str | None:
    held = _TOKEN.get()
    return held[0] if held else None
