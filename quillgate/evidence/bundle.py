"""What is signed: reviews a person may execute, and the evidence of an answer."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

REVIEW_SECONDS = 900


def _canonical(data: Any) -> bytes:
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def sign(data: Any, key: bytes) -> str:
    return hmac.new(key, _canonical(data), hashlib.sha256).hexdigest()


def signed_review(principal: str, review: dict[str, Any], key: bytes, *, now: float | None = None) -> dict[str, Any]:
    """A query put to a person: valid for them, as it stands, for a quarter of an hour."""
    body = {"principal": principal, "expires": (now or time.time()) + REVIEW_SECONDS, "review": review}
    return {**body, "signature": sign(body, key)}


def open_review(signed: dict[str, Any], principal: str, key: bytes, *, now: float | None = None) -> dict[str, Any]:
    body = {k: signed.get(k) for k in ("principal", "expires", "review")}
    if not hmac.compare_digest(str(signed.get("signature", "")), sign(body, key)):
        raise PermissionError("the review was changed")
    if body["principal"] != principal:
        raise PermissionError("the review is another's")
    if body["expires"] < (now or time.time()):
        raise PermissionError("the review has expired")
    return body["review"]


@dataclass(frozen=True)
class Evidence:
    """Why an answer or a refusal was given."""

    question: str
    principal: str
    catalog_hash: str
    query_hash: str
    status: str
    checks: tuple[str, ...]
    fingerprint: str | None = None
    row_count: int | None = None
    issues: tuple[str, ...] = ()
    evidence_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    at: float = field(default_factory=time.time)

    def signed(self, key: bytes) -> dict[str, Any]:
        body = json.loads(_canonical(asdict(self)))
        return {**body, "signature": sign(body, key)}


def verify(bundle: dict[str, Any], key: bytes) -> bool:
    body = {k: v for k, v in bundle.items() if k != "signature"}
    return hmac.compare_digest(str(bundle.get("signature", "")), sign(body, key))
