"""Settings that change what queries mean."""

from __future__ import annotations

from dataclasses import dataclass

REDACT_MODES = ("allow", "redact", "omit", "raise")
STORAGE_MODES = ("denormalized", "registry")
CONSISTENCY = ("minimize_latency", "at_least_as_fresh", "at_exact_snapshot", "fully_consistent")


@dataclass(frozen=True)
class Config:
    """max_hops: hops through arrows and user sets beyond which on_exceed acts ("raise" or "truncate"); None: as many as the data has."""

    max_hops: int | None = 8
    on_exceed: str = "raise"
    strict: bool = True
    allow_unscoped: bool = True
    unscoped_needs_reason: bool = True
    type_prefix: str = ""
    user_type: str = "auth/user"
    group_type: str = "auth/group"
    anonymous_type: str = "auth/anonymous"
    universal_admin: str = ""
    storage: str = "denormalized"
    redact_mode: str = "allow"
    conditional_visible: bool = False
    audit_denials: bool = False
    consistency: str = "minimize_latency"
    usersets_are_relations_only: bool = False
    caveat_errors: str = "deny"
    superuser_bypass: bool = False

    def problems(self) -> list[str]:
        """What is wrong with the settings."""
        out = []
        for name, allowed in (("on_exceed", ("raise", "truncate")), ("storage", STORAGE_MODES), ("redact_mode", REDACT_MODES), ("consistency", CONSISTENCY), ("caveat_errors", ("deny", "raise"))):
            if getattr(self, name) not in allowed:
                out.append(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        if self.max_hops is not None and self.max_hops < 1:
            out.append("max_hops must be at least 1")
        return out
