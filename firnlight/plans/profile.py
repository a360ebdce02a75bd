"""An immutable profile facade and the fixed order of processing steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, geometry, migration, moveout, shape, windows


@dataclass(frozen=True)
class Profile:
    """Traces, picks and the vectors all traces share; every step returns a new profile, lazily."""

    traces: DataFrame
    travel_time: tuple[float, ...]
    dt: float
    picks: DataFrame | None = None
    depth: tuple[float, ...] | None = None
    flags: dict = field(default_factory=dict)

    @property
    def snum(self) -> int:
        return len(self.travel_time)

    def _with(self, flag: str, value, **changes) -> Profile:
        return replace(self, flags=self.flags | {flag: value}, **changes)

    def hcrop(self, trace_num: int, side: str = "left") -> Profile:
        return self._with("hcrop", (trace_num, side), traces=shape.hcrop(self.traces, trace_num, side))

    def crop(self, start: int, stop: int | None = None) -> Profile:
        stop = self.snum if stop is None else stop
        t0 = self.travel_time[start]
        picks = None if self.picks is None else shape.crop_picks(self.picks, start, stop - start)
        return self._with("crop", (start, stop), traces=shape.crop(self.traces, start, stop), picks=picks,
                          travel_time=tuple(t - t0 for t in self.travel_time[start:stop]), depth=None if self.depth is None else self.depth[start:stop])

    def restack(self, count: int) -> Profile:
        picks = None if self.picks is None else shape.restack_picks(self.picks, count, self.snum)
        return self._with("restack", count, traces=shape.restack(self.traces, count), picks=picks)

    def reverse(self) -> Profile:
        picks = None if self.picks is None else shape.reverse(self.picks)
        return self._with("reverse", not self.flags.get("reverse", False), traces=shape.reverse(self.traces), picks=picks)

    def band_pass(self, low: float, high: float, order: int = 5, kind: str = "butter") -> Profile:
        return self._with("bpass", (low, high), traces=filters.vertical_band_pass(self.traces, self.dt, low, high, order, kind))

    def remove_mean(self, first: int, last: int) -> Profile:
        return self._with("hfilt", (first, last), traces=windows.remove_mean_trace(self.traces, list(self.travel_time), first, last))

    def adaptive(self, width: int) -> Profile:
        return self._with("ahfilt", width, traces=windows.adaptive_filter(self.traces, list(self.travel_time), width))

    def _from_long(self, flag: str, value, flat: DataFrame) -> Profile:
        """The profile with its samples replaced by long ones."""
        arrays = windows.to_arrays(flat, "profile_id", "trace_idx")
        return self._with(flag, value, traces=self.traces.drop("samples").join(arrays, ["profile_id", "trace_idx"]))

    def denoise(self, vertical: int = 1, horizontal: int = 10, noise: float | None = None, kind: str = "wiener") -> Profile:
        if kind == "median":
            return self._from_long("denoise", (vertical, horizontal), windows.median_filter(self.traces, horizontal, vertical))
        if kind != "wiener":
            raise ValueError(f"unknown filter {kind}")
        return self._from_long("denoise", (vertical, horizontal), windows.wiener(self.traces, vertical, horizontal, noise))

    def high_pass(self, wavelength: float, spacing: float) -> Profile:
        return self._from_long("hp", wavelength, filters.high_pass(self.traces, wavelength, spacing))

    def low_pass(self, wavelength: float, spacing: float) -> Profile:
        return self._from_long("lp", wavelength, filters.low_pass(self.traces, wavelength, spacing))

    def horizontal_band_pass(self, short: float, long: float, spacing: float) -> Profile:
        return self._from_long("hbp", (short, long), filters.horizontal_band_pass(self.traces, short, long, spacing))

    def elevate(self, velocity: float = 1.69e8) -> Profile:
        """Correct for elevation; the shared vectors keep the profile's own samples, as every trace now has more."""
        return self._with("elev", velocity, traces=shape.elevation_correct(self.traces, self.dt, velocity))

    def locate(self, fixes: DataFrame, offset: float = 0.0, extrapolate: bool = False) -> Profile:
        return self._with("geolocate", offset, traces=geometry.gps_control(self.traces, fixes, offset, extrapolate))

    def gain(self, slope: float) -> Profile:
        return self._with("rgain", slope, traces=windows.range_gain(self.traces, list(self.travel_time), slope))

    def agc(self, window: int = 50, scale: float = 50.0) -> Profile:
        return self._with("agc", window, traces=windows.agc(self.traces, window, scale))

    def moveout(self, separation: float, velocity: float = 1.69e8) -> Profile:
        times, depths, traces = moveout.moveout(self.traces, list(self.travel_time), self.dt, separation, velocity)
        return self._with("nmo", (separation, velocity), traces=traces, travel_time=tuple(times), depth=tuple(depths))

    def respace(self, spacing: float, values: list[str] | None = None) -> Profile:
        values = values or [c for c in ("lat", "long", "elev", "decday", "x_coord", "y_coord") if c in self.traces.columns]
        return self._with("interp", spacing, traces=geometry.constant_spacing(self.traces, spacing, values), picks=None)

    def migrate(self, kind: str, spacing: float, velocity: float = 1.68e8) -> Profile:
        flat = migration.migrate(self.traces, kind, list(self.travel_time), spacing, velocity)
        return self._from_long("mig", kind, flat)

    def validate(self) -> list[str]:
        """What is wrong with the profile; an empty list if nothing is. One pass over the traces."""
        need = ("profile_id", "trace_idx", "samples")
        found = [f"column {c} is missing" for c in need if c not in self.traces.columns]
        if found:
            return found
        row = self.traces.agg(F.sum((F.size("samples") != self.snum).cast("int")).alias("size"), F.sum(F.col("trace_idx").isNull().cast("int")).alias("index")).first()
        if row["size"]:
            found.append(f"{row['size']} traces do not have {self.snum} samples")
        if row["index"]:
            found.append(f"{row['index']} traces have no index")
        if self.depth is not None and len(self.depth) != self.snum:
            found.append("depths and samples differ in number")
        return found


#: Steps in the order in which they are applied, whatever order they are asked for.
ORDER: dict[str, Callable] = {
    "hcrop": Profile.hcrop, "restack": Profile.restack, "rev": Profile.reverse, "vbp": Profile.band_pass, "hfilt": Profile.remove_mean,
    "ahfilt": Profile.adaptive, "nmo": Profile.moveout, "denoise": Profile.denoise, "interp": Profile.respace, "crop": Profile.crop, "migrate": Profile.migrate,
}


def process(profile: Profile, **steps) -> Profile:
    """Apply the named steps, each with its arguments as a tuple (or True for none), in the fixed order."""
    unknown = set(steps) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    for name, step in ORDER.items():
        if name in steps:
            given = steps[name]
            profile = step(profile, *(() if given is True else given if isinstance(given, tuple) else (given,)))
    return profile
