"""What several operators share: scratch tables, keys of texts, dense numbering, word patterns."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but these six white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_roots: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only in local mode, where none is named (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="twinset-")
        spark.conf.set("spark.checkpoint.dir", base)
        _roots.append((spark, base))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/twinset-{uuid.uuid4().hex}-{tag}"
    _made.append((spark, path))
    return path


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, BATCH_ROWS)  # rows hold whole texts: batches of the default size take much memory on both sides
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, tag: str, since: int) -> DataFrame:
    """stored(), after which the scratch tables made since there were `since` of them go: only df may have read them."""
    at = made()
    out = stored(df, tag)
    kept = _made[at:]
    del _made[at:]
    release(since)
    _made.extend(kept)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does after a collection."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def made() -> int:
    """How many scratch tables there are, for release()."""
    return len(_made)


def release(since: int = 0) -> None:
    """Deletes the scratch tables made since there were so many, at exit all. Frames that still read one of them can't be
    used afterwards."""
    _delete(_made, since)


def _delete(tables: list[tuple[SparkSession, str]], since: int = 0) -> None:
    while len(tables) > since:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing is left to delete with
            return


atexit.register(_delete, _roots)
atexit.register(release)


def text_key(text: Column | str = "text") -> Column:
    """16 bytes that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and, but for single rows, bytes of a column."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (i - start >= rows or held + n > most_bytes):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def trimmed(run: Callable) -> Callable:
    """run, a function over batches; at its end the Python process gives back the memory that it no longer uses."""

    def run_and_trim(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run_and_trim


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once in a Python process: functions travel by value, so their modules hold nothing there."""
    held = sys.modules.setdefault("twinset_worker", types.ModuleType("twinset_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dense_slots(df: DataFrame, group: str, order: list[str], slot: str, partitions: int | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in the given order, with no task that holds a whole group.

    Rows are range partitioned by group and order, so that a large group spreads over many tasks; each task numbers
    its own rows, and the rows that earlier tasks hold of the same group are added from a table of counts.
    df should be narrow and cheap to read twice: ranges are found by sampling it.
    """
    part, local, base, tie, of, at = (free_name(df, x) for x in ("_part", "_local", "_base", "_tie", "_of", "_at"))
    keys = [group, *order, tie]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    ranged = ranged.withColumn(part, F.spark_partition_id())
    numbered = stored(
        ranged.withColumn(local, F.row_number().over(Window.partitionBy(part, group).orderBy(*order, tie)) - 1).drop(tie), "slots"
    )
    counts = numbered.groupBy(F.col(group).alias(of), F.col(part).alias(at)).agg(F.count(F.lit(1)).alias(local))
    earlier = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(of, at, F.coalesce(F.sum(local).over(earlier), F.lit(0)).alias(base))
    joined = numbered.join(bases, F.col(group).eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)))
    return joined.withColumn(slot, (F.col(local) + F.col(base)).cast("long")).drop(of, at, base, part, local)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


#: A table is broadcast up to so many rows and so many bytes of Parquet: some tens of MB as a hash table.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 12_000_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, a stored table, with a broadcast hint if it has at most so many rows and bytes; else Spark shuffles."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes and df.limit(rows + 1).count() <= rows else df
