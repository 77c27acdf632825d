"""Paths as arrays of components. Order paths by their components: as strings, a-b would come before a/b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def joined(components: Column) -> Column:
    return F.array_join(components, "/")


def parent(components: Column) -> Column:
    """null at the top."""
    return F.when(F.size(components) > 1, joined(F.slice(components, 1, F.size(components) - 1)))


def base_name(components: Column) -> Column:
    return F.element_at(components, -1)


def ancestors(components: Column) -> Column:
    """Array of the proper prefixes, as strings, the top first."""
    n = F.size(components)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: joined(F.slice(components, 1, k)))).otherwise(F.array().cast("array<string>"))


def prefixes(components: Column) -> Column:
    """Array of all prefixes, the path itself last."""
    return F.transform(F.sequence(F.lit(1), F.size(components)), lambda k: joined(F.slice(components, 1, k)))


def common_suffix(a: Column, b: Column) -> Column:
    """How many last components agree, at most one less than the shorter path has."""
    most = F.least(F.size(a), F.size(b)) - 1
    step = lambda got, k: F.when((got == k - 1) & (F.element_at(a, -k) == F.element_at(b, -k)), k).otherwise(got)
    return F.when(most >= 1, F.aggregate(F.sequence(F.lit(1), most), F.lit(0), step)).otherwise(0)


def without_last(components: Column, k: Column) -> Column:
    return joined(F.slice(components, F.lit(1), F.size(components) - k))


def quoted(path: Column) -> Column:
    """Each component percent-encoded, blanks as +."""
    return F.array_join(F.transform(parts(path), lambda p: F.url_encode(p)), "/")


def with_prefix(path: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "/"), path) if prefix else path


def below(path: Column, prefix: str) -> Column:
    return path.startswith(prefix + "/")


def without_prefix(path: Column, prefix: str) -> Column:
    return F.substring(path, F.lit(len(prefix) + 2), F.length(path))
