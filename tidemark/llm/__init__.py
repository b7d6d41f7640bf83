"""Operators for language-model training data. Nothing outside this subpackage imports it."""

from __future__ import annotations


def registries() -> list:
    """The query registries of this subpackage, in the order of the problems."""
    from tidemark.llm import queries

    return [queries.REG]
