"""The registered queries of this subpackage (importing a module registers its queries)."""

from . import (  # noqa: F401
    bpe,
    chat_format,
    conversation_repair,
    exact_dedup,
    html_text,
    jaccard_join,
    lexical_search,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    url_filter,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
