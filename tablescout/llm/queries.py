"""All queries of this folder and their SQL."""

from __future__ import annotations

from tablescout.llm import (  # noqa: F401
    chat,
    decontamination,
    exact_dedup,
    html_text,
    lexical,
    licences,
    merkle,
    mixing,
    packing,
    quality,
    simhash,
    toxicity,
    warc,
)
from tablescout.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
