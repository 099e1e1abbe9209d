"""Pauses of a recording put on its drawn line, each where the one before lets it be."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideline.shipping import ship

#: Metres of way around a guess in which a pause is looked for, and how far back its drawing begins.
SNAP_M, BACK_M = 200.0, 50.0
RADIUS_M = 6_371_000.0


def _metres(lat: np.ndarray, lon: np.ndarray, to_lat: float, to_lon: float) -> np.ndarray:
    a, b = np.radians(lat), np.radians(to_lat)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(to_lon - lon) / 2) ** 2
    return 2 * RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def on_line(lat: np.ndarray, lon: np.ndarray, pauses: list[dict]) -> list[tuple[int, int]]:
    """First and last vertex of each stretch of a line that pauses take, in order; stretches that meet are one.

    A pause is looked for around the way that its recording made since the pause before, counted from where that one
    ended on the line: a line that comes back to a place has several vertices there. It takes as much way as was gone
    during it, and its drawing begins BACK_M before.
    """
    if len(lat) < 2:
        return []
    way = np.append(0.0, np.cumsum(_metres(lat[:-1], lon[:-1], lat[1:], lon[1:])))
    if way[-1] <= 0:
        return []
    vertex = lambda m: int(np.searchsorted(way, min(max(m, 0.0), way[-1]), "left"))  # noqa: E731  the first at or beyond m
    found, at, km = [], 0, 0.0
    for p in pauses:
        if p["lat"] is None or p["lon"] is None:
            continue
        guess = way[at] + max(0.0, p["d"] - km) * 1000
        lo, hi = vertex(guess - SNAP_M), vertex(guess + SNAP_M)
        stop = lo + int(np.argmin(_metres(lat[lo : hi + 1], lon[lo : hi + 1], p["lat"], p["lon"])))
        km = p["d"] if p["d2"] is None else p["d2"]
        gone = max(0.0, km - p["d"]) * 1000
        if p["rlat"] is not None and p["rlon"] is not None and p["move_m"] is not None:
            gone = p["move_m"]
        first, at = vertex(way[stop] - BACK_M), vertex(way[stop] + gone)
        if at > first:
            found.append((first, at))
    out: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda x: x[0]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def snapped(line: DataFrame, pauses: DataFrame, run: str, order: str) -> DataFrame:
    """run, i0, i1: the stretches of each run's line (order, lat, lon; vertices count from 0) that its pauses take.

    pauses: run, d and d2 (km at stop and resume), lat, lon, rlat, rlon (places of both), move_m (way gone between). A
    search begins at the result before, so this is a fold over one run's line and pauses, which meet in one task; runs
    without a line or without pauses with a place have no rows.
    """
    kind = line.schema[run].dataType.simpleString()
    ship(line.sparkSession)

    def fold(keys: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by(order), right.sort_by("d")
        got = on_line(*(left[c].to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon")), right.to_pylist()) if left.num_rows and right.num_rows else []
        return pa.table({run: pa.array([keys[0].as_py()] * len(got), keys[0].type), "i0": pa.array([a for a, _ in got], pa.int64()), "i1": pa.array([b for _, b in got], pa.int64())})

    ways = line.where("lat is not null and lon is not null").select(run, order, "lat", "lon")
    stops = pauses.select(run, "d", "d2", "lat", "lon", "rlat", "rlon", "move_m")
    return ways.groupBy(run).cogroup(stops.groupBy(run)).applyInArrow(fold, f"{run} {kind}, i0 long, i1 long")
