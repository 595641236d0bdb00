"""Who may ask: a registry of tokens, groups and principals, read from JSON."""

from __future__ import annotations

import base64
import bisect
import hashlib
import hmac
import itertools
import json
import threading
import time
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from quillgate.plans.ir import Plan, Predicate
from quillgate.session import Principal


def _filters(items: list[dict[str, Any]]) -> tuple[Predicate, ...]:
    """Filters in the plan's own JSON form."""
    return Plan.from_dict({"source": "_", "filters": items}).filters


@dataclass(frozen=True)
class Registry:
    """``{"tenant": ..., "tokens": {token: id}, "groups": {name: grant}, "principals": {id: grant}}`` with
    grants ``{"groups": [...], "allowed_tables": [...], "row_filters": [...]}``.

    A principal sees the tables of its own grant and of its groups together, and is held to the row
    filters of all of them. No list of tables anywhere means every table, which only ``open_by_default``
    permits.
    """

    tenant: str
    tokens: Mapping[str, str]
    groups: Mapping[str, Mapping[str, Any]]
    principals: Mapping[str, Mapping[str, Any]]
    open_by_default: bool = False

    @classmethod
    def from_json(cls, text: str) -> Registry:
        data = json.loads(text)
        if unknown := set(data) - {"tenant", "tokens", "groups", "principals", "open_by_default"}:
            raise ValueError(f"unknown keys in the registry: {sorted(unknown)}")
        out = cls(data.get("tenant", ""), data.get("tokens", {}), data.get("groups", {}), data.get("principals", {}), data.get("open_by_default", False))
        for who in out.principals:
            out.principal(who)
        if lost := sorted(set(out.tokens.values()) - set(out.principals)):
            raise ValueError(f"tokens of unknown principals: {lost}")
        return out

    def principal(self, who: str) -> Principal:
        if who not in self.principals:
            raise PermissionError(f"unknown principal {who!r}")
        own = self.principals[who]
        grants = [own]
        for g in own.get("groups", ()):
            if g not in self.groups:
                raise ValueError(f"principal {who} is in an unknown group {g!r}")
            grants.append(self.groups[g])
        lists = [g["allowed_tables"] for g in grants if "allowed_tables" in g]
        if not lists and not self.open_by_default:
            raise PermissionError(f"principal {who!r} is granted no table")
        tables = frozenset(t for ts in lists for t in ts) if lists else None
        filters = tuple(dict.fromkeys(f for g in grants for f in _filters(list(g.get("row_filters", ())))))
        return Principal(who, self.tenant, tables, filters)

    def by_token(self, token: str) -> Principal:
        """Every token is compared, in constant time each."""
        found = None
        for known, who in self.tokens.items():
            if hmac.compare_digest(known.encode(), token.encode()):
                found = who
        if found is None:
            raise PermissionError("unknown token")
        return self.principal(found)


def _part(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def signed_principal(token: str, key: bytes, registry: Registry, *, audience: str | None = None, issuer: str | None = None, now: float | None = None, leeway_s: float = 30) -> Principal:
    """The principal a signed web token (HS256) is about; its subject must stand in the registry.

    Refused are other signatures and algorithms, a token without an end, one that has ended or hasn't
    begun (give or take ``leeway_s``), and one for another audience or from another issuer.
    """
    now = time.time() if now is None else now
    try:
        head, body, seal = token.split(".")
        if json.loads(_part(head)).get("alg") != "HS256" or not hmac.compare_digest(hmac.new(key, f"{head}.{body}".encode(), hashlib.sha256).digest(), _part(seal)):
            raise PermissionError("the token's signature does not hold")
        claims = json.loads(_part(body))
    except (ValueError, AttributeError) as e:
        raise PermissionError("not a signed token") from e
    if not isinstance(claims.get("exp"), (int, float)) or now > claims["exp"] + leeway_s or now < claims.get("nbf", now) - leeway_s:
        raise PermissionError("the token is out of its time")
    audiences = claims.get("aud", [])
    if audience is not None and audience not in ([audiences] if isinstance(audiences, str) else audiences):
        raise PermissionError("the token is for another audience")
    if issuer is not None and claims.get("iss") != issuer:
        raise PermissionError("the token is from another issuer")
    return registry.principal(str(claims.get("sub", "")))


def forwarded_principal(headers: Mapping[str, str], registry: Registry, *, secret: str, name: str = "X-Principal", proof: str = "X-Proxy-Secret") -> Principal:
    """The principal a trusted proxy names in a header; the proxy proves itself by a secret in another."""
    given = {k.lower(): v for k, v in headers.items()}
    if not secret or not hmac.compare_digest(given.get(proof.lower(), "").encode(), secret.encode()):
        raise PermissionError("the proxy is not known")
    return registry.principal(given.get(name.lower(), ""))


def development_principal(registry: Registry, who: str, *, host: str) -> Principal:
    """A fixed principal for work on one's own machine; refused where the service listens to others."""
    if host not in ("127.0.0.1", "::1", "localhost"):
        raise PermissionError("a fixed principal is for the local machine only")
    return registry.principal(who)


@dataclass
class RateLimit:
    """A bucket of tokens for each principal."""

    per_minute: float = 60
    burst: float = 10
    _level: dict[str, tuple[float, float]] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def allow(self, who: str, now: float | None = None) -> bool:
        now = time.monotonic() if now is None else now
        with self._lock:
            level, at = self._level.get(who, (self.burst, now))
            level = min(self.burst, level + (now - at) * self.per_minute / 60)
            allowed = level >= 1
            self._level[who] = (level - allowed, now)
            return allowed


@dataclass
class Counters:
    """Outcomes and seconds, in the text form monitoring systems read; of the seconds only sums and counts by bound are kept."""

    bounds: tuple[float, ...] = (0.1, 0.5, 1, 5, 30)
    _outcomes: Counter = field(default_factory=Counter)
    _within: dict[str, list[int]] = field(default_factory=dict)
    _sums: Counter = field(default_factory=Counter)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, status: str, code: str, seconds: float) -> None:
        with self._lock:
            self._outcomes[status, code] += 1
            self._sums[status] += seconds
            within = self._within.setdefault(status, [0] * (len(self.bounds) + 1))
            within[bisect.bisect_left(self.bounds, seconds)] += 1

    def text(self) -> str:
        with self._lock:
            lines = [f'asks_total{{status="{s}",code="{c}"}} {n}' for (s, c), n in sorted(self._outcomes.items())]
            for status, within in sorted(self._within.items()):
                upto = list(itertools.accumulate(within))
                lines += [f'ask_seconds_bucket{{status="{status}",le="{b:g}"}} {n}' for b, n in zip(self.bounds, upto, strict=False)]
                lines += [f'ask_seconds_sum{{status="{status}"}} {self._sums[status]:g}', f'ask_seconds_count{{status="{status}"}} {upto[-1]}']
        return "\n".join(lines) + "\n"
