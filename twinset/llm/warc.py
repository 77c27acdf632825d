"""WARC archives of pages, read back, with an external merge of their capture index.

Each writing task makes one archive and one run of index lines (URL key, timestamp, digest, length, offset, archive),
sorted in the task. Runs are merged by loser trees, FAN_IN at a time and level by level, each level in a task for each
range of lines, so that the last parts in their order hold all captures by URL key and timestamp.
Archives, runs and parts are files below one folder, which all machines must reach; they are written by pyarrow's file
systems (file, hdfs, s3, ...). A task that is run again writes other file names; only those of the run that counts
are listed in the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_slots, scratch_path, stored

#: Runs that one merging task reads at once.
FAN_IN = 64
#: Lines between two entries of a run's own index, by which a merging task finds the start of its range.
STRIDE = 512
#: Places that each run offers as bounds of ranges.
BOUNDS_PER_RUN = 32
LINES_PER_RANGE = 2_000_000


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """Host labels from last to first, then path and query: captures of one URL, and of one site, sort together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return quote(url, safe="")
    rest = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + quote(rest.lower(), safe="/?&=%+,;:@!$'()*~.-_")


class LoserTree:
    """Merges sorted iterators; each step plays one path from a leaf to the root. Ties go to the earlier iterator."""

    def __init__(self, sources: list[Iterable[bytes]]):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(sources))
        self.heads: list[bytes | None] = [next(s, None) for s in self.sources] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (left, right) if self._before(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[bytes]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.sources[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _record(kind: str, uri: str, date: str, page: object, digest: str, payload: bytes, n: int, refers: object, charset: str = "utf-8") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}|{uri}')}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            head.append(f"X-Refers-To-Page-Id: {refers}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _run_file(fs, path: str, lines: Iterable[bytes]) -> tuple[int, list[tuple[bytes, int]]]:
    n, at, marks = 0, 0, []
    with fs.open_output_stream(path) as out:
        for line in lines:
            if n % STRIDE == 0:
                marks.append((line, at))
            out.write(line + b"\n")
            at += len(line) + 1
            n += 1
    with fs.open_output_stream(path + ".marks") as out:
        for line, at in marks:
            out.write(b"%d %s\n" % (at, line))
    return n, marks


def _bounds(marks: list[tuple[bytes, int]]) -> list[str]:
    step = max(1, len(marks) // BOUNDS_PER_RUN)
    return [line.decode("latin-1") for line, _ in marks[step::step]]


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        lines, at, out = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = "revisit" if row["revisit"] else "response"
                uri = quote(row["url"] or "-", safe="/?&=%+,;:@!$'()*~.-_#[]")
                member = gzip.compress(_record(kind, uri, row["date"], row["page_id"], digest, payload, len(payload), row["refers_to"]), level, mtime=0)
                out.write(member)
                stamp = "".join(c for c in row["date"] if c.isdigit())
                lines.append(f"{url_key(row['url'])} {stamp} {digest} {kind} {len(member)} {at:012d} {name}.warc.gz".encode())
                at += len(member)
        if out is not None:
            out.close()
            lines.sort()
            n, marks = _run_file(fs, f"{root}/{name}.cdx", lines)
            yield pa.RecordBatch.from_pydict({"warc": [f"{name}.warc.gz"], "run": [f"{name}.cdx"], "lines": [n], "bounds": [_bounds(marks)]})

    return run


def _records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each gzip member of an archive; holds one record at a time."""
    at, buffer = 0, b""
    while True:
        inflate, got, start = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if not buffer:
                buffer = stream.read(1 << 20)
                if not buffer:
                    if got:
                        raise ValueError("an archive ends within a record")
                    return
            got.append(inflate.decompress(buffer))
            at += len(buffer) - len(inflate.unused_data)
            buffer = inflate.unused_data
        head, _, rest = b"".join(got).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield start, headers, rest[: int(headers["Content-Length"])]


def _read(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        for frame in frames:
            for name in frame["warc"]:
                rows = []
                with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20, compression=None) as stream:
                    for offset, headers, block in _records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                        digest, size, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Content-Length"]), headers["WARC-Type"]
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if found != digest or len(payload) != size:
                                raise ValueError(f"{name}, record at {offset}: the payload is not what was written")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        rows.append((name, offset, page, size, digest, kind, refers))
                        if len(rows) == 20_000:
                            yield pd.DataFrame(rows, columns=READ_COLUMNS)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=READ_COLUMNS)

    return run


READ_COLUMNS = ["warc", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _lines_from(fs, path: str, low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """The lines of a run with low <= line < high."""
    at = 0
    if low is not None:
        with fs.open_input_stream(path + ".marks") as marks:
            for mark in io.BufferedReader(marks):
                place, _, line = mark.rstrip(b"\n").partition(b" ")
                if line > low:
                    break
                at = int(place)
    with fs.open_input_file(path) as file:
        file.seek(at)
        for line in io.BufferedReader(file, 1 << 18):
            line = line.rstrip(b"\n")
            if high is not None and line >= high:
                return
            if low is None or line >= low:
                yield line


def _merge(folder: str, cuts: list[bytes], shift: int, level: int):
    """Each row's files, merged from the first to the last of the 2 ** shift ranges between cuts that its range spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        for frame in frames:
            for slot, r, files in zip(frame["slot"], frame["r"], frame["files"]):
                first, last = r << shift, (r + 1) << shift
                low, high = cuts[first - 1] if r else None, cuts[last - 1] if last <= len(cuts) else None
                tree = LoserTree([_lines_from(fs, f"{root}/{f['file']}", low, high) for f in files])
                name = f"merged{level}-{slot:08d}-{r:08d}-{TaskContext.get().taskAttemptId()}.cdx"
                n, _ = _run_file(fs, f"{root}/{name}", tree)
                yield pd.DataFrame({"slot": [slot], "r": [r], "file": [name], "lines": [n]})

    return run


def _cuts(runs: DataFrame, ranges: int) -> list[bytes]:
    """ranges - 1 of the bounds that runs offer, ascending, with about as many bounds between each two; none without bounds."""
    offered = runs.select(F.lit(0).alias("all"), F.explode("bounds").alias("bound"))
    n = offered.count()
    if ranges < 2 or not n:
        return []
    places = runs.sparkSession.createDataFrame([(n * i // ranges, i) for i in range(1, ranges)], "slot long, i int")
    rows = dense_slots(offered, "all", ["bound"], "slot").join(F.broadcast(places), "slot").select("i", "bound").collect()  # ranges - 1
    return [r["bound"].encode("latin-1") for r in sorted(rows)]


#: Tasks that a level of merging is dealt over at most; a task may have several ranges to merge.
MOST_TASKS = 20_000


def merge_runs(spark: SparkSession, folder: str, runs, fan_in: int = FAN_IN, lines_per_range: int = LINES_PER_RANGE) -> list[str]:
    """runs: (run, lines, bounds), a table or a list, files in folder. Returns the files that, one after another, hold
    all lines in order.

    Each level merges `fan_in` runs into one that is split into ranges, the more the fewer runs are left, so that no task
    writes much more than lines_per_range lines. The driver holds the cuts between ranges and the names of the last
    files, one for each range; runs stay in tables.
    """
    if isinstance(runs, list):
        runs = spark.createDataFrame(runs, "run string, lines long, bounds array<string>")
    n, lines = runs.agg(F.count(F.lit(1)), F.sum("lines")).first()
    if not n:
        return []
    halvings = max(0, math.ceil(math.log2(max(1, lines / lines_per_range))))
    cuts = _cuts(runs, 2**halvings)
    halvings = halvings if cuts else 0
    files = dense_slots(runs.select(F.lit(0).alias("all"), F.col("run").alias("file")), "all", ["file"], "slot").select("slot", F.lit(0).alias("r"), "file")
    level = have = 0
    while True:
        groups = -(-n // fan_in)
        want = max(have, halvings - math.ceil(math.log2(groups)))
        parts = 2 ** (want - have)
        finer = files.withColumn("r", F.explode(F.sequence((F.col("r") * parts).cast("int"), ((F.col("r") + 1) * parts - 1).cast("int"))))
        tasks = finer.groupBy(F.floor(F.col("slot") / fan_in).alias("group"), "r").agg(F.array_sort(F.collect_list(F.struct("slot", "file"))).alias("files"))
        dealt = tasks.withColumnRenamed("group", "slot").repartition(min(MOST_TASKS, groups * 2**want), "slot", "r")
        files = stored(dealt.mapInPandas(_merge(folder, cuts, halvings - want, level), "slot long, r int, file string, lines long"), "merged")
        n, have, level = groups, want, level + 1
        if groups == 1:
            return [r["file"] for r in files.select("r", "file").orderBy("r").collect()]


def _history(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        for frame in frames:
            for part, name in zip(frame["part"], frame["run"]):
                rows = []
                for k, line in enumerate(_lines_from(fs, f"{root}/{name}", None, None)):
                    key, stamp, _, _, length, offset, warc = line.decode().split(" ")
                    rows.append((part, k, key, stamp, int(length), int(offset), warc))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=HISTORY_COLUMNS)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=HISTORY_COLUMNS)

    return run


HISTORY_COLUMNS = ["history_part", "history_line", "url_key", "timestamp", "record_length", "offset", "warc"]
HISTORY_SCHEMA = "history_part int, history_line long, url_key string, timestamp string, record_length long, offset long, warc string"


def archive(pages: DataFrame, folder: str, captured: Column, min_bytes: int = 0, level: int = 1) -> tuple[DataFrame, list[str]]:
    """Writes a record for each row of pages (page_id, url, html) below folder, and the merged index.

    Returns the manifest (warc, run, lines, bounds), one row an archive, and the index parts in their order. Null html
    is an empty payload, null url is "-". Of records with equal payloads of at least min_bytes bytes that with the
    largest page_id is a response, and so are rows that repeat it; the others are revisits. If all of their page_ids
    are null, all are responses. An empty table gives no archive and no index. Other columns are ignored.
    """
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    last = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    last = last.where("n > 1 and refers_to is not null").select(F.col("digest").alias("of"), "refers_to")
    known = rows.join(last, F.col("digest") == F.col("of"), "left").withColumn("revisit", F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    written = known.select("page_id", "url", "html", F.coalesce("date", F.lit("1970-01-01T00:00:00Z")).alias("date"), "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"))
    manifest = stored(written.mapInArrow(_write(folder, level), "warc string, run string, lines long, bounds array<string>"), "manifest")
    return manifest, merge_runs(pages.sparkSession, folder, manifest.select("run", "lines", "bounds"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, page_type: str = "bigint") -> DataFrame:
    """warc, offset, page_id, payload_bytes, payload_digest, record_type, refers_to of every record; payloads are checked."""
    names = manifest.select("warc").repartition(min(MOST_TASKS, max(1, manifest.count())), "warc")  # a number, so that few names stay apart
    out = names.mapInPandas(_read(folder), "warc string, offset long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


def read_history(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame:
    """The capture histories: (history_part, history_line) is the order by URL key and timestamp over all archives."""
    listed = spark.createDataFrame(list(enumerate(parts)), "part int, run string").repartition(max(1, len(parts)), "part")
    return listed.mapInPandas(_history(folder), HISTORY_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each of pages, read back. pages have no capture time; here it is the page_id in seconds after the
    start of 2024. Nulls, empty payloads, ties, repeated rows, other columns and an empty table are as in archive()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, "warc")
    manifest, parts = archive(pages, folder, F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0))))
    records = read_archives(spark, folder, manifest)
    return read_history(spark, folder, parts).join(records, ["warc", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "history_part", "history_line")


#: The same in DuckDB for URLs of plain characters without user names, ports and fragments, and an index of one range.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS x, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]+)', 1) AS query FROM p),
k AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * g + 1, 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
             array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[.]', ''), '.')), ',') || ')' || lower(CASE WHEN path = '' THEN '/' ELSE path END || query) AS url_key,
             max(page_id) OVER (PARTITION BY x) AS top, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
       url_key, timestamp, 0 AS history_part, CAST(row_number() OVER (ORDER BY url_key, timestamp) - 1 AS BIGINT) AS history_line FROM k"""
