"""What a request takes from its surroundings, once: clock, scope, session and rules."""

from __future__ import annotations

import hashlib
import hmac
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from factweave import constants as K


@dataclass(frozen=True)
class Runtime:
    """Read once when a request begins, so that all its steps see the same."""

    scope_key: str
    now: int
    rules_version: int
    session: str | None = None


def session_key(session: str, key: bytes) -> str:
    """A session's name as it may be stored: keyed, so it can't be guessed back."""
    return hmac.new(key, session.encode(), hashlib.sha256).hexdigest()


def capture(user: str, project: str, clock: Callable[[], float] = time.time, session: str | None = None, key: bytes | None = None) -> Runtime:
    """The clock in whole seconds, the scope of a user and project, and the session under a key."""
    scope, now = f"u:{user}/p:{project}", int(clock())
    if not re.match(K.SCOPE_KEY, scope):
        raise ValueError("INVALID_SCOPE_KEY")
    if not 0 <= now <= K.MAX_SAFE:
        raise ValueError("INVALID_CLOCK")
    if session is not None and not key:
        raise ValueError("SESSION_KEY_MISSING")
    return Runtime(scope, now, K.RULES_VERSION, None if session is None else session_key(session, key))
