"""Registration of queries with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from barsmith.sources import tables as t

_OPERATORS = "add radd sub rsub mul rmul truediv rtruediv and rand or ror invert neg gt ge lt le eq ne getitem".split()


class Later:
    """A column expression that is written down now and made by now(): columns need a running session, and
    the list of queries is read without one."""

    __hash__ = object.__hash__

    def __init__(self, make: Callable):
        self._make = make

    def __getattr__(self, name: str) -> Later:
        return Later(lambda: getattr(self._make(), name))

    def __call__(self, *args, **named) -> Later:
        return Later(lambda: self._make()(*map(now, args), **{k: now(v) for k, v in named.items()}))


for _name in _OPERATORS:
    setattr(Later, f"__{_name}__", lambda self, *args, _n=f"__{_name}__": Later(lambda: getattr(self._make(), _n)(*map(now, args))))


def now(x):
    if isinstance(x, Later):
        return x._make()
    return [now(v) for v in x] if isinstance(x, list) else x


QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "bars": (t.BARS, ()), "profiles": (t.PROFILES, ()), "bench": (t.BENCH, ("bars",)), "fundamentals": (t.FUNDAMENTALS, ()), "shares": (t.SHARES, ("bars",)),
    "macro": (t.MACRO, ()), "scores": (t.SCORES, ("bars",)), "fills": (t.FILLS, ()),
}


def with_views(*names: str, sql: str, more: str = "") -> str:
    """sql behind the named views, each after those that it needs; more: further common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        text, needs = VIEWS[name]
        for n in needs:
            add(n)
        done.setdefault(name, text)

    for n in names:
        add(n)
    return "with recursive " + ",\n".join([*done.values(), *([more] if more else [])]) + "\n" + sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def over(n: int, by: str = "ticker") -> str:
    """SQL: the last n rows of the ticker."""
    return f"over (partition by {by} order by date rows between {n - 1} preceding and current row)"


def prior(n: int) -> str:
    return f"over (partition by ticker order by date rows between {n} preceding and 1 preceding)"


def following(n: int) -> str:
    return f"over (partition by ticker order by date rows between 1 following and {n} following)"


LINE = "over (partition by ticker order by date)"
SO_FAR = "over (partition by ticker order by date rows between unbounded preceding and current row)"
