"""All registered queries and oracles, merged from the query modules."""

from __future__ import annotations

from tracelens.plans import call_queries, eval_queries, io_queries, trace_queries

_MODULES = [trace_queries, eval_queries, call_queries, io_queries]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
