"""Band shares of window power."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEYS = ["entity_id", "window_id"]

# Frequency bands in Hz, lower end included.
BANDS = {"pow_lf": (0.5, 4.0), "pow_mf": (4.0, 15.0), "pow_hf": (15.0, 40.0)}


def spectral_bands(samples: DataFrame) -> DataFrame:
    """Power fractions of three bands and the high ratio per window; null below eight samples.

    Spark groups the samples by window; the transform of one window is the only Python step.
    """

    names = [*BANDS, "pow_hf_ratio"]

    def bands(window: pa.Table) -> pa.Table:
        v = window["value"].to_numpy()[np.argsort(window["pos"].to_numpy())]
        shares = [None] * len(names)
        if len(v) >= 8:
            power = np.abs(np.fft.rfft(v)) ** 2 / len(v)
            hz = np.fft.rfftfreq(len(v), 1.0 / float(window["fs"][0].as_py()))
            total = power.sum() + 1e-12
            part = [power[(hz >= low) & (hz < high)].sum() / total for low, high in BANDS.values()]
            shares = [*part, part[2] / (part[0] + part[1] + 1e-12)]
        keys = {k: window[k].slice(0, 1) for k in KEYS}
        return pa.table({**keys, **{n: pa.array([x], pa.float64()) for n, x in zip(names, shares)}})

    fields = samples.schema
    head = ", ".join(f"{k} {fields[k].dataType.simpleString()}" for k in KEYS)
    schema = head + ", " + ", ".join(f"{c} double" for c in names)
    return samples.select(*KEYS, "pos", "value", "fs").groupBy(*KEYS).applyInArrow(bands, schema)
