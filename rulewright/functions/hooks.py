"""Type-specific rewrites of headers: before the match, and as a second chance after a miss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[DataFrame], DataFrame]
_HOOKS: dict[tuple[str, str, str], Hook] = {}
KINDS = ("precondition", "fallback", "update")


def hook(kind: str, instrument: str, filekind: str) -> Callable[[Hook], Hook]:
    """Register a rewrite of headers(params, ...) for one type."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")

    def add(f: Hook) -> Hook:
        _HOOKS[kind, instrument, filekind] = f
        return f

    return add


def apply_hook(kind: str, instrument: str, filekind: str, headers: DataFrame) -> DataFrame:
    """The rewritten headers; unchanged where the type has no such hook."""
    f = _HOOKS.get((kind, instrument, filekind))
    return f(headers) if f else headers


def hooked(kind: str, filekind: str) -> list[str]:
    """Instruments that have a hook of this kind for a type."""
    return sorted(i for k, i, f in _HOOKS if (k, f) == (kind, filekind))


def apply_hooks(kind: str, filekind: str, headers: DataFrame, instrument: str = "rmap") -> DataFrame:
    """Headers of all instruments, those rewritten that have a hook; one pass over the headers per hook."""
    names = hooked(kind, filekind)
    out = headers.where(~F.coalesce(F.col(instrument).isin(names), F.lit(False))) if names else headers
    for name in names:
        out = out.unionByName(apply_hook(kind, name, filekind, headers.where(F.col(instrument) == name)))
    return out
