"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, for the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketframe.llm.jaccard_join import Rule, similar_groups

RULE = Rule(words=5, under=8, over=10)


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest doc_id reachable over links. Texts without
    words are one group. Every link is found, see ``jaccard_join``."""
    return similar_groups(docs, RULE, empty_together=True).select("doc_id", "component_id")
