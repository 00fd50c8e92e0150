"""Energy prices: sensitivity of demand, shifts towards the Medium band, checks and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bands

#: Limits and, by word in the zone's category, base of the sensitivity.
LEAST, MOST = 0.05, 0.7
BASES = [(("residential",), 0.45), (("commercial", "mall"), 0.32), (("cbd", "office"), 0.24), (("transport", "hub"), 0.2), (("industrial",), 0.18)]
OTHER_BASE = 0.28


def elasticity(category: Column, occupancy: Column, rain: Column, rain_hours: Column | None = None, of_window: Column | None = None, of_behaviour: Column | None = None) -> Column:
    """The window's own value, else the reported behaviour's, without sign; else a base by category, lowered by occupancy
    (share or percent) and rain (the window's, else the zone's rain hours). Always within the limits."""
    name, base = F.lower(F.coalesce(category, F.lit(""))), None
    for words, value in BASES:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(name, F.lit(w))
        base = F.when(found, value) if base is None else base.when(found, value)
    share = F.coalesce(F.when(occupancy > 1, occupancy / 100).otherwise(occupancy), F.lit(0.0))
    factor = 1 - 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    known = [c for c in (rain, rain_hours) if c is not None]
    wet = F.when(F.coalesce(*known, F.lit(0.0)) > 0, 0.85).otherwise(1.0)
    given = [F.abs(c) for c in (of_window, of_behaviour) if c is not None]
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.coalesce(*given, base.otherwise(OTHER_BASE) * factor * wet)))


def shift_to_medium(load: Column, low: Column, high: Column, sensitivity: Column, suggested: Column) -> Column:
    """The price shift in percent that moves the expected load into Medium, -100 at least.

    Inside Medium a small suggested shift stays unless it would leave the band. Loads of 1e-9 and less, which may be
    traces of rounding, count as none.
    """
    wanted = F.round(F.coalesce(suggested, F.lit(0.0)), 2)
    small = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), wanted))
    expected = F.greatest(F.lit(0.0), load * (1 - sensitivity * small / 100))
    stays = (expected >= bands.threshold(low, high, bands.LOW_END)) & (expected < bands.threshold(low, high, bands.MEDIUM_END))
    medium = bands.classify(bands.range_position(load, low, high)) == bands.MEDIUM
    outside = (1 - F.try_divide(bands.target(load, low, high), load)) / sensitivity * 100
    moved = F.when(medium, F.when(stays, small).otherwise(0.0)).otherwise(outside)
    unusable = (load <= 1e-9) | (high <= low) | (sensitivity <= 0)
    return F.greatest(F.lit(-100.0), F.when(unusable, wanted).otherwise(moved))


def action_label(shift: Column) -> Column:
    return F.when(shift > 0, "Raise energy price").when(shift < 0, "Reduce energy price").otherwise("Hold window energy price")


def finalized(base: Column, shift: Column, proposed: Column) -> dict[str, Column]:
    """Price from shift, or shift from price; a price is valid if it isn't negative."""
    price = F.coalesce(proposed, base * (1 + shift / 100))
    change = F.coalesce(shift, F.when(base != 0, (F.try_divide(proposed, base) - 1) * 100), F.lit(0.0))
    return {
        "suggested_price_shift_pct": F.round(change, 4),
        "proposed_energy_price": F.round(price + 1e-9, 4),  # halves go up, whatever the last bits
        "price_valid": F.coalesce(F.round(price, 10) >= 0, F.lit(False)),
    }


def compared(predicted: Column, baseline: Column) -> dict[str, Column]:
    """Difference to the baseline price, and in percent of it where it isn't 0."""
    return {"price_difference": predicted - baseline, "price_difference_pct": F.when(baseline != 0, F.try_divide(predicted - baseline, baseline) * 100)}
