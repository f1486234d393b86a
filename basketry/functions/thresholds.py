"""Support thresholds, in exact arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction


def absolute_support(min_sup: int | float | str | Fraction, n_tids: int) -> int:
    """An int is taken as it is; a float, string or Fraction in (0, 1] is a share of ``n_tids``, rounded up.

    Shares go through ``Fraction(str(x))``, so 0.4 of 10 is 4 and not 5.
    """
    if isinstance(min_sup, bool):
        raise ValueError("min_sup must be a number")
    if isinstance(min_sup, int):
        if min_sup < 1:
            raise ValueError("an absolute min_sup must be 1 or more")
        return min_sup
    share = min_sup if isinstance(min_sup, Fraction) else Fraction(str(min_sup))
    if not 0 < share <= 1:
        raise ValueError("a relative min_sup must be in (0, 1]")
    return max(1, math.ceil(share * n_tids))


def check_lossless(old: int, new: int, total: int) -> None:
    """An incremental update loses nothing only if a set infrequent in both parts can't reach ``total``."""
    if total < old + new - 1:
        raise ValueError(f"threshold {total} for the union is below {old} + {new} - 1: sets could be missed")
