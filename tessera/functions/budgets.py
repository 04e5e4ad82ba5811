"""How many tokens to keep: the rounding rules of the methods, as columns.

Ratios are DOUBLE.  ``bround`` rounds half to even; all results are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped(x: Column, low, high: Column) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, int) else low, F.least(high, x)).cast("long")


def _product(total: Column, ratio: float) -> Column:
    return total.cast("double") * F.lit(float(ratio))


def half_even(total: Column, ratio: float, low=1) -> Column:
    """round(total * ratio), half to even, from ``low`` (a number or a column) to total."""
    return _clamped(F.rint(_product(total, ratio)).cast("long"), low, total)


def floored(total: Column, ratio: float) -> Column:
    return _clamped(F.floor(_product(total, ratio)), 1, total)


def half_up(total: Column, ratio: float) -> Column:
    return _clamped(F.floor(_product(total, ratio) + 0.5), 1, total)


def explicit_or_ratio(total: Column, target: int | None, ratio: float, rounding: str = "round") -> Column:
    """A fixed target, or a share of the total rounded by ``round`` (half to even) or ``floor``."""
    if target is not None:
        return _clamped(F.lit(int(target)).cast("long"), 1, total)
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1], got {ratio}")
    return half_even(total, ratio) if rounding == "round" else floored(total, ratio)


def frame_split(n: Column, ratio: float, alpha: float, expansion: float = 1.0) -> tuple[Column, Column, Column]:
    """Per-frame budget, its share for diverse tokens, and the rest."""
    frame = F.ceil(n.cast("double") * F.lit(min(1.0, ratio * expansion))).cast("long")
    diverse = F.ceil(frame.cast("double") * F.lit(min(1.0, max(0.0, alpha)))).cast("long")
    return frame, diverse, frame - diverse


def even_split(total: Column, parts: Column, index: Column, most: Column | None = None) -> Column:
    """``total`` over ``parts``, the remainder to the earliest."""
    share = F.floor(total / parts) + F.when(index < total % parts, 1).otherwise(0)
    return (share if most is None else F.least(most, share)).cast("long")


def hybrid_retention(layers: int, pruning_layer: int, expansion: float) -> float:
    """(L - K g) / (g (L - K)); the arguments must give a ratio in (0, 1]."""
    if layers <= 0 or not 0 <= pruning_layer < layers or expansion <= 0:
        raise ValueError("layers, pruning_layer or expansion out of range")
    out = (layers - pruning_layer * expansion) / (expansion * (layers - pruning_layer))
    if not 0 < out <= 1:
        raise ValueError(f"retention {out} is not in (0, 1]")
    return out
