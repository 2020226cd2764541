"""Named queries: name -> callable(spark, sf_dir), and their SQL twins."""

from __future__ import annotations

from . import q_behavior, q_graph, q_text

_MODULES = (q_graph, q_behavior, q_text)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
