"""All registered queries."""

from __future__ import annotations

from tarnhelm.plans import detection, evaluation, evidence, exchange, governance

_MODULES = (detection, governance, evidence, evaluation, exchange)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
