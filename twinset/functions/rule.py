"""Which metadata must agree for a match to count as identical."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ["mtime_match", "atime_match", "ctime_match", "mode_match", "owner_match", "group_match"]


@dataclass(frozen=True)
class MatchRule:
    include_mtime: bool = True
    include_atime: bool = False
    include_ctime: bool = False
    include_mode: bool = True
    include_owner: bool = True
    include_group: bool = True

    def to_dict(self) -> dict[str, bool]:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict[str, bool]) -> MatchRule:
        """Missing keys take the defaults; others are ignored."""
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    def holds(self) -> Column:
        """One boolean over the match columns; what is not included folds away as a constant."""
        included = [F.col(flag) for flag in FLAGS if getattr(self, "include_" + flag.removesuffix("_match"))]
        return reduce(lambda a, b: a & b, included, F.lit(True))


def compared(a: str = "a", b: str = "b") -> list[Column]:
    """The six comparisons of two catalog rows under the given aliases. Times are whole nanoseconds, modes are whole."""
    pairs = zip(FLAGS, ["mtime_ns", "atime_ns", "ctime_ns", "mode", "uid", "gid"])
    return [(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))).alias(flag) for flag, c in pairs]
