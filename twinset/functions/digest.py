"""Content hashes. A hash algorithm is a name with its length in bytes, a function from content to a hex column, and, where
hashlib does not know the name, a function from an open file to a hex string."""

from __future__ import annotations

import filecmp
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HashAlgorithm = tuple  # (bytes, content -> column[, file -> str])

ALGORITHMS: dict[str, HashAlgorithm] = {"sha256": (32, lambda content: F.sha2(content, 256))}


def algorithm(name: str | None, known: dict[str, HashAlgorithm] | None = None) -> HashAlgorithm:
    known = known or ALGORITHMS
    if not name:
        raise RuntimeError("the index has not been built: no hash algorithm is set")
    if name not in known:
        raise RuntimeError(f"unknown hash algorithm: {name}")
    return known[name]


def content_digest(content: Column, name: str = "sha256", known: dict[str, HashAlgorithm] | None = None) -> Column:
    return algorithm(name, known)[1](content)


def file_digests(files: DataFrame, root: str, name: str = "sha256", known: dict[str, HashAlgorithm] | None = None) -> DataFrame:
    """files with a digest column, from the files' bytes below root, which the executors must see. A file that is gone
    or can't be read has a null digest."""
    own = algorithm(name, known)[2:]
    digest = own[0] if own else lambda f: hashlib.file_digest(f, name).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    with open(f"{root}/{path}", "rb") as f:
                        found.append(digest(f))
                except OSError:
                    found.append(None)
            yield frame.assign(digest=found)

    return files.mapInPandas(run, files.drop("digest").schema.simpleString()[7:-1] + ", digest string")


def same_bytes(a: str, b: str) -> bool:
    """Byte by byte; what can't be read is different."""
    try:
        return filecmp.cmp(a, b, shallow=False)
    except OSError:
        return False


def with_equal_bytes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of pairs, with columns left and right of paths below a and b, whose files have the same bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[same_bytes(f"{a}/{x}", f"{b}/{y}") for x, y in zip(frame["left"], frame["right"])]]

    return pairs.mapInPandas(run, pairs.schema)
