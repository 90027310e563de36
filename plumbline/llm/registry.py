"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, html_text, licenses, media, negatives, ngram_join, pii, quality, search, substring_dedup, suffix_tree

MODULES = (media, chat, quality, substring_dedup, ngram_join, pii, bpe, licenses, suffix_tree, decontaminate, search, negatives, html_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
