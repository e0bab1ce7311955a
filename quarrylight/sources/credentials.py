"""Tokens for hosted services: from the environment, or from a supplier that a process renews before they end.

No token ever enters a plan or an option: options name an environment variable, or a supplier as `module:function`,
which an executor imports and calls.
"""

from __future__ import annotations

import importlib
import os
import threading
import time
from collections.abc import Callable
from datetime import datetime

#: Seconds before its end that a token is renewed, and seconds that one lasts whose end is not told. Fixed values.
SKEW, LIFE = 120, 3600


def end_of(expires_at: str | None, now: float) -> float:
    """When a token ends, from its ISO text; an hour from now if that is missing or no time."""
    try:
        return datetime.fromisoformat((expires_at or "").replace("Z", "+00:00")).timestamp()
    except ValueError:
        return now + LIFE


class TokenSupplier:
    """A token that is asked for again shortly before it ends, one for all threads of a process.

    mint: gives (token, when it ends as ISO text or None).
    """

    def __init__(self, mint: Callable[[], tuple[str, str | None]], clock: Callable[[], float] = time.time, skew: float = SKEW):
        self.mint, self.clock, self.skew = mint, clock, skew
        self._lock, self._token, self._end = threading.Lock(), "", 0.0

    def get(self) -> str:
        with self._lock:
            now = self.clock()
            if not self._token or now >= self._end - self.skew:
                self._token, expires_at = self.mint()
                self._end = end_of(expires_at, now)
            return self._token


_suppliers: dict[str, TokenSupplier] = {}
_lock = threading.Lock()


def supplier(name: str) -> TokenSupplier:
    """The process's supplier of a name `module:function`; the function mints a token."""
    with _lock:
        if name not in _suppliers:
            module, function = name.split(":", 1)
            _suppliers[name] = TokenSupplier(getattr(importlib.import_module(module), function))
        return _suppliers[name]


def token(options: dict[str, str]) -> str:
    """The token that a reader's options name by `token_supplier` or `token_env`; empty without either."""
    if options.get("token_supplier"):
        return supplier(options["token_supplier"]).get()
    return os.environ.get(options.get("token_env", ""), "")


def headers(options: dict[str, str]) -> dict[str, str]:
    """The headers of a call: by `auth` `private` as GitLab has it, else as a bearer. Fixed names."""
    held = token(options)
    out = {"User-Agent": "quarrylight"}
    if options.get("auth") == "private":
        return out | ({"PRIVATE-TOKEN": held} if held else {})
    out |= {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}
    return out | ({"Authorization": f"Bearer {held}"} if held else {})
