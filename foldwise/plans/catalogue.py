"""Queries over the driver's tables, and the DuckDB SQL each must equal.

Samples come from ``events`` (p = ts, label of six hours, group = user_id) in the order (ts, event_id) unless said
otherwise. The SQL tests intervals pair by pair, where the library sweeps.
"""

from __future__ import annotations

from foldwise.plans import studies, validation


def queries():
    return {**{k: v[0] for k, v in validation.QUERIES.items()}, **{k: v[0] for k, v in studies.QUERIES.items()}}


def oracle_sql():
    return {k: v[1] for k, v in {**validation.QUERIES, **studies.QUERIES}.items() if v[1]}
