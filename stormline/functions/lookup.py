"""Value lookups and bucketing."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Planetary index Kp to its linear equivalent ap.
KP_TO_AP = {
    0.00: 0, 0.33: 2, 0.67: 3, 1.00: 4, 1.33: 5, 1.67: 6, 2.00: 7,
    2.33: 9, 2.67: 12, 3.00: 15, 3.33: 18, 3.67: 22, 4.00: 27,
    4.33: 32, 4.67: 39, 5.00: 48, 5.33: 56, 5.67: 67, 6.00: 80,
    6.33: 94, 6.67: 111, 7.00: 132, 7.33: 154, 7.67: 179, 8.00: 207,
    8.33: 236, 8.67: 300, 9.00: 400,
}

# Flare class letter to peak flux in W/m2.
FLARE_SCALE = {"A": 1e-8, "B": 1e-7, "C": 1e-6, "M": 1e-5, "X": 1e-4}

# Upper bounds (inclusive) of the Kp regimes and ap levels.
KP_REGIME = (2, 4, 6)
AP_LEVEL = (10, 30, 80, 200)


def literal_map(table: dict, value: Column) -> Column:
    pairs = [F.lit(x) for x in chain.from_iterable(table.items())]
    return F.try_element_at(F.create_map(*pairs), value)


def nearest_lookup(value: Column, table: dict[float, float]) -> Column:
    """Exact key if present, else the nearest key (the lower of two equally near); NULL for NULL."""
    keys = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(v)).alias("v")) for k, v in sorted(table.items())])
    near = F.array_min(F.transform(keys, lambda e: F.struct(F.abs(value - e["k"]).alias("d"), e["k"].alias("k"), e["v"].alias("v"))))
    return F.when(value.isNotNull(), near["v"])


def kp_to_ap(kp: Column) -> Column:
    return nearest_lookup(F.bround(kp, 2), KP_TO_AP)


def bucket_right_closed(value: Column, bounds: Sequence[float]) -> Column:
    """0 up to and including the first bound, then 1, ...; NULL for NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, bound in enumerate(bounds):
        out = out.when(value <= bound, i)
    return out.otherwise(len(bounds))


def class_to_flux(flare_class: Column, fallback: Column | None = None) -> Column:
    """"M2.5" -> 2.5e-5; a bare letter is 0; anything else is NULL, or the fallback."""
    upper = F.upper(flare_class)
    number = F.substr(upper, F.lit(2))
    size = F.when(number == "", 0.0).otherwise(number.try_cast("double"))
    flux = literal_map(FLARE_SCALE, F.substr(upper, F.lit(1), F.lit(1))) * size
    return flux if fallback is None else F.coalesce(flux, fallback)
