"""Load bands: a load's place in the zone's historical range, and the band's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH, EXTREME = BANDS = "Low", "Medium", "High", "Extremely High"
#: Upper ends of the bands and the targets inside Medium, in percent of the range.
LOW_END, MEDIUM_END, HIGH_END = 35.0, 80.0, 90.0
LOWER_TARGET, UPPER_TARGET = 35.5, 79.5
#: Accepted names of bands.
ALIASES = {"low": LOW, "medium": MEDIUM, "moderate": MEDIUM, "high": HIGH, "extremely high": EXTREME, "extreme high": EXTREME, "critical": EXTREME}


def band_name(text: Column) -> Column:
    """A band's own name from an alias in any case, with spaces or underscores; null if unknown."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return names[F.lower(F.trim(F.replace(text, F.lit("_"), F.lit(" "))))]


def rank(band: Column) -> Column:
    return F.when(band.isNotNull(), F.array_position(F.array(*[F.lit(b) for b in BANDS]), band).cast("int"))


def range_position(load: Column, low: Column, high: Column) -> Column:
    """Percent of the range; 50 in a flat range, 0 where anything is unknown, no upper end."""
    place = F.greatest(F.lit(0.0), F.try_divide(load - low, high - low) * 100)
    return F.when(load.isNull() | low.isNull() | high.isNull(), 0.0).when(high <= low, 50.0).otherwise(place)


def classify(position: Column) -> Column:
    p = F.coalesce(position, F.lit(0.0))
    return F.when(p < LOW_END, LOW).when(p < MEDIUM_END, MEDIUM).when(p < HIGH_END, HIGH).otherwise(EXTREME)


def threshold(low: Column, high: Column, percent: float | Column) -> Column:
    """The load at a percentage of the range; the minimum is at least 0, the maximum at least the minimum."""
    floor = F.greatest(F.lit(0.0), F.coalesce(low, F.lit(0.0)))
    top = F.greatest(floor, F.coalesce(high, floor))
    return floor + (top - floor) * percent / 100


def target(load: Column, low: Column, high: Column) -> Column:
    """Loads outside Medium move just inside it."""
    own = F.greatest(F.lit(0.0), F.coalesce(load, F.lit(0.0)))
    lower, upper = threshold(low, high, LOW_END), threshold(low, high, MEDIUM_END)
    return F.when(own < lower, threshold(low, high, LOWER_TARGET)).when(own >= upper, threshold(low, high, UPPER_TARGET)).otherwise(own)
