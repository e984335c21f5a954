"""Errors of the engine."""


class AuthzError(Exception):
    """Base of all."""


class SchemaError(AuthzError):
    """A schema that does not parse, validate or compose."""


class CaveatUnsupported(AuthzError):
    """A caveat expression outside the supported language."""


class DepthExceeded(AuthzError):
    """A recursion that goes on beyond the hop limit."""


class PermissionDenied(AuthzError):
    """A guarded operation on rows that the actor may not touch."""


class MissingActor(AuthzError):
    """A secured frame without an actor in strict mode."""


class UnscopedNotAllowed(AuthzError):
    """A bypass that the configuration forbids or that gives no reason."""


class StoreBehind(AuthzError):
    """The store has not seen the version that a read asks for."""
