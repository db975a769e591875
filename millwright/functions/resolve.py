"""Column resolution by alias (planning-time helper, runs on ``df.columns``).

Exact case-insensitive match first; the fallback only matches a name that is
a whole ``_``-separated token run inside a column name, so ``line`` does not
match ``baseline`` and ``time`` does not match ``planned_time_min`` unless a
full token sequence lines up.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Optional


def _tokens(name: str) -> list[str]:
    return [t for t in str(name).lower().split("_") if t]


def _contains_tokens(haystack: list[str], needle: list[str]) -> bool:
    if not needle or len(needle) > len(haystack):
        return False
    n = len(needle)
    return any(haystack[i : i + n] == needle for i in range(len(haystack) - n + 1))


def find_col(columns: Iterable[str], *names: str, exact_only: bool = False) -> Optional[str]:
    cols = list(columns)
    lower = {str(c).lower(): c for c in cols}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    if exact_only:
        return None
    for n in names:
        needle = _tokens(n)
        for c in cols:
            if _contains_tokens(_tokens(c), needle):
                return c
    return None


def require_col(columns: Iterable[str], *names: str) -> str:
    c = find_col(columns, *names)
    if c is None:
        raise ValueError(f"none of the columns {names} present")
    return c
