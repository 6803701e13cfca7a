"""Who asks: tenant, scopes and types."""

from __future__ import annotations

from dataclasses import dataclass

from medlode.errors import Forbidden


@dataclass(frozen=True)
class Access:
    tenant: str
    subject: str = "system"
    scopes: frozenset[str] = frozenset({"read", "write", "auditlog"})
    types: frozenset[str] | None = None

    @classmethod
    def from_claims(cls, claims: dict) -> Access:
        """sub is needed; tenant falls back to it; scopes are words in any case; nothing else is granted."""
        if not claims.get("sub"):
            raise Forbidden("no subject")
        words = frozenset(str(claims.get("scope", "")).lower().split())
        types = claims.get("resources")
        return cls(claims.get("tenant") or claims["sub"], claims["sub"], words & {"read", "write", "auditlog"}, None if types is None else frozenset(t.lower() for t in types))

    def check(self, kind: str, scope: str) -> None:
        if scope not in self.scopes:
            raise Forbidden(f"scope {scope} is missing")
        if self.types is not None and kind.lower() not in {t.lower() for t in self.types}:
            raise Forbidden(f"{kind} is not allowed")
