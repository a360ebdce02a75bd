"""Normal moveout, depths and their resampling.

The bracketing samples and weights of the new axis depend on the profile only;
they are computed once for its samples and applied row by row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import doubles


def lerp(traces: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Samples at ``new`` from samples at the rising axis ``old``, linear; row-local."""
    at = np.clip(np.searchsorted(old, new, "right") - 1, 0, len(old) - 2)
    w = (new - old[at]) / (old[at + 1] - old[at])
    low, weight = F.array(*[F.lit(int(a)) for a in at]), doubles(w)
    return traces.withColumn("samples", F.zip_with(low, weight, lambda a, x: F.get("samples", a) * (1 - x) + F.get("samples", a + 1) * x))


def moveout(traces: DataFrame, travel_time: list[float], dt: float, separation: float, velocity: float = 1.69e8, firn: float = 0.0) -> tuple[list[float], list[float], DataFrame]:
    """(travel times, depths, traces) corrected for the distance between antennas (m)."""
    t = np.asarray(travel_time, float)
    s = 1e6 * separation / velocity
    inside = (t + s) ** 2 - s**2
    if (inside < 0).any():
        raise ValueError("travel times start before the pulse leaves")
    moved = np.sqrt(inside)
    axis = np.arange(t.min(), moved.max(), dt * 1e6)
    if axis[0] < moved[0] - 1e-12:
        raise ValueError("rebase the travel times by a crop first")
    return axis.tolist(), (axis / 2 * velocity * 1e-6 + firn).tolist(), lerp(traces, moved, axis)


def even_depths(traces: DataFrame, depths: list[float]) -> tuple[list[float], DataFrame]:
    """Samples at evenly spaced depths between the first and the last."""
    d = np.asarray(depths, float)
    new = np.linspace(d[0], d[-1], len(d))
    return new.tolist(), lerp(traces, d, new)


def depths_of(travel_time: list[float], depth: list[float], density: list[float], permittivity, speed: float = 3e8) -> list[float]:
    """Depth of each travel time under a density profile: steps of half the time at the velocity of the nearest depth."""
    u = speed / np.sqrt([permittivity(r) for r in density])
    z_known = np.asarray(depth, float)
    t = np.asarray(travel_time, float)
    step = t[1] - t[0]
    solid = speed / np.sqrt(permittivity(917.0))
    out, z = [], 0.0
    for x in t:
        if x < 0:
            out.append(x / 2 * solid * 1e-6)
        elif x < step:
            z = x / 2 * u[0] * 1e-6
            out.append(z)
        else:
            z += step / 2 * u[int(np.abs(z_known - z).argmin())] * 1e-6
            out.append(z)
    return out


def rms_depths(travel_time: list[float], depth: list[float], density: list[float], permittivity, dt: float, speed: float = 3e8, ice: float = 1.69e8, rounds: int = 1000) -> list[float]:
    """Depths that agree with the root-mean-square velocity above them, by fixed-point rounds."""
    t = np.asarray(travel_time, float)
    base = np.asarray(depths_of(travel_time, depth, density, permittivity, speed))
    u = np.gradient(base, t) * 2e6
    d = t / 2 * ice * 1e-6
    for k in range(rounds):
        mean = np.array([np.sqrt(np.mean(u[base <= x] ** 2)) if (base <= x).any() else u[0] for x in d])
        new = t / 2 * mean * 1e-6
        if k >= 5 and np.abs(new - d).max() <= 0.1 * dt / 2 * ice:
            return new.tolist()
        d = new
    return d.tolist()
