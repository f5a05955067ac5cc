"""Checks of scalar parameters on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable


def positive(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be a finite positive number")
    return value


def whole(name: str, value: int, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return value


def ordered(name: str, low: int, high: int) -> tuple[int, int]:
    if whole(name, low, 1) > whole(name, high, 1):
        raise ValueError(f"{name}: {low} is above {high}")
    return low, high


def names(given: Iterable[str], known: tuple[str, ...]) -> list[str]:
    """Names in the known order, each once; unknown or repeated ones are errors."""
    cut = [g.strip().lower() for g in given]
    if len(set(cut)) < len(cut) or not set(cut) <= set(known):
        raise ValueError(f"names must be different ones of {', '.join(known)}")
    return [k for k in known if k in cut]


def truth(text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on", "y", "t"):
        return True
    if low in ("0", "false", "no", "off", "n", "f"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


def id_list(text: str) -> list[int]:
    return [int(p) for p in text.replace(",", " ").split()]
