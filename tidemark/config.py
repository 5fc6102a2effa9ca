"""Dates, windows and thresholds of the customer operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """as_of is the last day of the data; the other values are the business rules' fixed values."""

    as_of: dt.date = dt.date(2001, 7, 31)
    active_window_days: int = 365
    min_expected_return_days: int = 7
    momentum_window_days: int = 180
    trailing_months: int = 12
    ltv_months: tuple[int, ...] = (3, 6, 12, 18, 24)
    lapse_multiple: float = 2.0
    seed: int = 42
    reengagement_dates: tuple[dt.date, ...] = tuple(dt.date(y, m, d) for y in (1999, 2000, 2001) for m, d in ((1, 31), (4, 30), (7, 31), (10, 31)) if (y, m) <= (2001, 4))
    cross_sell_dates: tuple[dt.date, ...] = tuple(dt.date(y, m, d) for y in (1999, 2000, 2001) for m, d in ((1, 31), (4, 30), (7, 31), (10, 31)) if (y, m) <= (2001, 1))


DEFAULT = Config()
