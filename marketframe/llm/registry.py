"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("suffix_dedup", "lm_score", "bpe", "ann", "warc", "decontaminate", "simhash", "quality", "token_counts", "html_text", "merkle", "jaccard_join", "ranked_search")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"marketframe.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
