"""The registry of everything outside the subpackage llm."""

from __future__ import annotations

from ..operators.intervals import p4_found
from ..operators.nested import p6_found, p6_nodes
from . import careers, extraction, match, people, pool, records, search, texts
from .registry import Registry
from .sql_found import P4_FOUND, P6_FOUND

registry = Registry()
registry.add("p4_found", p4_found, P4_FOUND)
registry.add("p6_found", p6_found, P6_FOUND)
registry.add("p6_nodes", p6_nodes)
for part in (texts, careers, pool, search, records, extraction, people, match):
    for name, query in part.registry.queries.items():
        registry.add(name, query, part.registry.sql.get(name))
