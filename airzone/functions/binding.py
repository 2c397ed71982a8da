"""Naming intermediate values inside one SQL expression."""

from __future__ import annotations


def named_values(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in values.items()) + ")"


def bind(levels: dict[str, dict[str, str]], result: str) -> str:
    """``result`` with every level's values computed once and read as ``level.name``.

    A level may use the levels before it. Long formulas need each intermediate
    value several times; as a chain of projections they grow exponentially when
    Catalyst substitutes the chain into a filter or a join key, bound they stay
    linear.
    """
    for level, values in reversed(levels.items()):
        result = f"transform(array({named_values(values)}), {level} -> {result})[0]"
    return result
