"""Table functions for SQL, to be joined with LATERAL.

    SELECT t.trace_idx, p.* FROM traces t, LATERAL pick_packet(t.samples, 120, 13, 5, 4, 1) p
    SELECT f.path, p.name FROM files f, LATERAL project_files(f.content) p
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="samp1 double, samp2 double, samp3 double, power double")
class PickPacket:
    """The strongest return of a trace around a sample and the opposite ones beside it; no row without samples.

    Arguments: samples, midpoint, then the window's length, half wave, margin and polarity.
    """

    def eval(self, samples: list, midpoint: float, length: int, half_wave: int, margin: int, polarity: int):
        from firnlight.operators.picks import PickWindow, pick_one

        if samples and midpoint is not None:
            window = PickWindow(length, half_wave, margin, polarity)
            window.check()
            top, centre, bottom, power = pick_one(np.array([np.nan if v is None else v for v in samples]), window, midpoint)
            yield float(top), float(centre), float(bottom), float(power)


@udtf(returnType="name string, content binary")
class ProjectFiles:
    """The files within a project blob, in their order; none of null."""

    def eval(self, content: bytes):
        from firnlight.sources.binary import split_project

        if content is not None:
            yield from split_project(bytes(content)).items()


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("pick_packet", PickPacket)
    spark.udtf.register("project_files", ProjectFiles)
