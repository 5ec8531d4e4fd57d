"""JSON over HTTP with one taxonomy of failures, for sinks and models alike. No URL, token or text ever stands in a message."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Reply:
    status: int
    headers: Mapping[str, str]
    body: bytes


Transport = Callable[[str, str, Mapping[str, str], bytes | None, float], Reply]


class Failed(Exception):
    """A call that another try won't mend."""


class Retryable(Failed):
    """A failure worth another try; ``after`` seconds if the other side said so."""

    def __init__(self, message: str = "", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


class TimedOut(Failed):
    pass


class Limited(Retryable):
    """Too many requests."""


def urlopen(method: str, url: str, headers: Mapping[str, str], body: bytes | None, timeout: float) -> Reply:
    request = urllib.request.Request(url, data=body, headers=dict(headers), method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Reply(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read())
    except urllib.error.HTTPError as e:
        return Reply(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


def seconds(value: str | None) -> float | None:
    try:
        return float((value or "").strip())
    except ValueError:
        return None


def call(name: str, method: str, url: str, payload: dict | None = None, headers: Mapping[str, str] | None = None, timeout: float = 30.0, transport: Transport = urlopen) -> dict[str, Any]:
    """One request; the reply's object, empty if it has none. 429 and 5xx may be tried again, all else may not."""
    body = None if payload is None else json.dumps(payload).encode()
    try:
        reply = transport(method, url, {"content-type": "application/json", **(headers or {})}, body, timeout)
    except TimeoutError:
        raise TimedOut(f"{name}: no reply within {timeout:.0f} s") from None
    except (OSError, ValueError) as e:
        if isinstance(getattr(e, "reason", None), TimeoutError):
            raise TimedOut(f"{name}: no reply within {timeout:.0f} s") from None
        raise Failed(f"{name}: no connection ({type(e).__name__})") from None
    if reply.status == 429:
        raise Limited(f"{name}: status 429", seconds(reply.headers.get("retry-after")))
    if reply.status >= 500:
        raise Retryable(f"{name}: status {reply.status}", seconds(reply.headers.get("retry-after")))
    if not 200 <= reply.status < 300:
        raise Failed(f"{name}: status {reply.status}")
    try:
        found = json.loads(reply.body or b"{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}
