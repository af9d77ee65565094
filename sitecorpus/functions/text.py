"""Spark SQL text for expressions.

Larger expressions are written as SQL text and parsed once by Spark, which is
much quicker to set up than a tree of Python calls.  Names ending in ``_sql``
take and give SQL text.
"""

from __future__ import annotations


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(texts: list[str]) -> str:
    return ", ".join(quoted(t) for t in texts)


def endings(texts: list[str]) -> str:
    """Pattern for text that ends in one of ``texts``."""
    return "(?:" + "|".join(t.replace(".", "\\.") for t in texts) + ")\\z"
