"""Differences in the times of two files, and texts for times, sizes and shares."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES = ["atime", "ctime", "mtime", "birthtime"]


def differences(a: str = "a", b: str = "b", times: list[str] | None = None) -> Column:
    """Array of (type, a, b) in nanoseconds for the times that differ between two regular files."""
    each = [F.when(~F.col(f"{a}.{t}_ns").eqNullSafe(F.col(f"{b}.{t}_ns")), F.struct(F.lit(t).alias("type"), F.col(f"{a}.{t}_ns").alias("a"), F.col(f"{b}.{t}_ns").alias("b"))) for t in times or TIMES[:3]]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def metadata_diff(pairs: DataFrame, times: list[str] | None = None) -> DataFrame:
    """A row for each time that differs. pairs has structs a and b with kind and times; other kinds than files raise."""
    regular = F.when((F.col("a.kind") == "file") & (F.col("b.kind") == "file"), differences(times=times)).otherwise(F.raise_error(F.lit("only regular files have comparable metadata")))
    return pairs.withColumn("d", F.explode(regular)).select(*[c for c in pairs.columns if c not in ("a", "b")], F.col("d.type").alias("type"), F.col("d.a").alias("a_ns"), F.col("d.b").alias("b_ns"))


def iso_micros(ns: Column) -> Column:
    """UTC time with microseconds, as the index dump shows it."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_nanos(ns: int) -> str:
    seconds, rest = divmod(ns, 1_000_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{rest:09d}"


def human_size(n: int) -> str:
    """1024 steps from B to PB, two decimals from KB on. Formatted here: Java rounds half up, Python half even."""
    if n < 1024:
        return f"{n} B"
    size, units = float(n), ["KB", "MB", "GB", "TB", "PB"]
    for unit in units:
        size /= 1024
        if size < 1024 or unit == units[-1]:
            return f"{size:.2f} {unit}"
    raise AssertionError


def percentage(part: int, whole: int) -> str:
    """One decimal; ~ before 100.0 % or 0.0 % that is so only by rounding."""
    if not whole:
        return "0.0%"
    text = f"{100 * part / whole:.1f}%"
    rounded = (text == "100.0%" and part != whole) or (text == "0.0%" and part != 0)
    return "~" + text if rounded else text
