"""Scalar formulas as SQL text that Spark evaluates with ``expr``; doubles throughout, guarded against division by zero."""

from __future__ import annotations


def rounded(x: str, digits: int = 6) -> str:
    """Half up towards positive infinity."""
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def unit(x: str) -> str:
    """Clamped to [0, 1]."""
    return f"greatest(0e0, least(1e0, {x}))"


def feature(x: str) -> str:
    """A component of a state vector: rounded to 6 digits, in [0, 1]."""
    return unit(rounded(x))


def sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def ratio(a: str, b: str, otherwise: str = "0e0") -> str:
    return f"(case when ({b}) = 0 then {otherwise} else ({a}) / ({b}) end)"


def half_interval(x: str) -> str:
    """[-1, 1] to [0, 1]."""
    return f"((({x}) + 1e0) / 2e0)"
