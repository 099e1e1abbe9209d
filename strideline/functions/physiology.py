"""Column functions of running physiology."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the energy cost of running on a slope (Minetti et al. 2002), highest power first.
SLOPE_COST = (155.4, -30.4, -43.3, 46.3, 19.5, 3.6)


def slope_cost(grade: Column) -> Column:
    out = F.lit(SLOPE_COST[0])
    for c in SLOPE_COST[1:]:
        out = out * grade + c
    return out


def ga_seconds(seconds: Column, gain_m: Column, km: Column) -> Column:
    """Flat-equivalent time: half the gain over the whole distance is the mean grade; without a distance, the time itself."""
    return F.when(km > 0, seconds * SLOPE_COST[-1] / slope_cost(gain_m / 2 / (km * 1000))).otherwise(seconds.cast("double"))


def oxygen_cost(metres_per_minute: Column) -> Column:
    return 0.000104 * metres_per_minute * metres_per_minute + 0.182258 * metres_per_minute - 4.60


def vdot(dist_m: Column, seconds: Column) -> Column:
    """VO2max that a single all-out effort implies, by Daniels' and Gilbert's formula."""
    t = seconds / 60
    return oxygen_cost(dist_m / t) / (0.8 + 0.1894393 * F.exp(-0.012778 * t) + 0.2989558 * F.exp(-0.1932605 * t))


def riegel(seconds: Column, from_m: Column | float, to_m: Column | float, power: float = 1.06) -> Column:
    return seconds * F.pow(F.lit(to_m) / F.lit(from_m) if not isinstance(from_m, Column) else F.lit(to_m) / from_m, F.lit(power))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    """Metres between two places given in degrees; null where a coordinate is."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h))))  # least() passes over nulls


def clock(seconds: Column) -> Column:
    """M:SS of rounded seconds; 59.6 carries into the minute."""
    s = F.round(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
