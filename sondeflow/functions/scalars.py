"""Scalar functions whose null, rounding and tie rules differ between engines, each with one stated rule."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN becomes null; everything after ingest relies on it."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low, high) -> Column:
    """Held between bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def half_even(x: Column, digits: int) -> Column:
    """Rounded to some digits, half to even as the product with 10^digits shows it: 0.145 at two digits is 0.14, as 14.499999999999998 lies below the half."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def row_id(key: Column, index: Column) -> Column:
    return F.concat_ws("_", key.cast("string"), index.cast("string"))


def id_key(row_id_: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(row_id_, r"^(.*)_([^_]*)$", 1)


def id_index(row_id_: Column) -> Column:
    """The number after the last underscore, null if it is none."""
    return F.regexp_extract(row_id_, r"^(.*)_([^_]*)$", 2).try_cast("long")


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits order as numbers: each is padded with zeros."""
    padded = F.regexp_replace(name, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def stable_seed(*parts: Column) -> Column:
    """crc32 of the parts joined by colons."""
    return F.crc32(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def sampled(key: Column, seed: int, percent: int) -> Column:
    """True for about `percent` of the keys, the same on every run and partitioning."""
    return F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), F.lit(100)) < percent


def unwrapped_step(step: Column) -> Column:
    """An angle's step taken to within half a turn."""
    return step - 2 * math.pi * F.floor((step + math.pi) / (2 * math.pi))


def cut(x: Column, edges: list[float]) -> Column:
    """Bin number for right-closed bins (a, b], the first closed on both sides; null outside."""
    out = F.when(x < edges[0], None)
    for k, edge in enumerate(edges[1:]):
        out = out.when(x <= edge, F.lit(k))
    return out


def iso_now(zone: str = "UTC") -> Column:
    """The time of the query in a zone, as 2024-01-31T12:00:00."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone), "yyyy-MM-dd'T'HH:mm:ss")


def evenly(low: float, high: float, n: int) -> Column:
    """An array of n numbers from low to high in equal steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / max(n - 1, 1)))


def place_in(values: Column, x: Column, right: bool = False) -> Column:
    """Where x would go into a sorted array: before its equals, or (right) behind them."""
    return F.size(F.filter(values, (lambda v: v <= x) if right else (lambda v: v < x)))


def argmin(values: Column) -> Column:
    """Place, from 0, of the first smallest number of an array."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def running(values: Column) -> Column:
    """Running sums of an array."""
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["out"], F.array(a["s"] + v)).alias("out")))["out"]


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON object in text, null if it has none."""
    return F.get_json_object(text, f"$.{name}")


def looked_up(x: Column, table: dict) -> Column:
    """The value that a small dictionary has for x, null for others."""
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)
