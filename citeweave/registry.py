"""All queries by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from citeweave.operators import candidates, capitals, citing, comparing, dictionary, grading, layout, lists, lookup, matching, segmenting, spans, tagging, texts, titles
from citeweave.plans import queries as rendering

MODULES = (matching, candidates, lists, rendering, grading, texts, dictionary, lookup, segmenting, tagging, citing, layout, comparing, titles, spans, capitals)
QUERIES: dict[str, Callable] = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.SQL.items()}
FLAGSHIP = "match_best_passage"
