"""WARC archives with a globally ordered capture index (dealt operator 9).

Each task writes its pages to a compressed archive, a gzip member per record, and a run: the index entries of its records,
sorted by URL key and timestamp. The runs are then merged externally. Ranges of keys come from samples that the runs carry;
a task merges the slices that a bounded number of runs have in one range, with a loser tree and a batch of each run in
memory, and passes follow until each range is one run. Records are read back through the merged index. Runs and groups of
runs are rows of tables in the shared folder, so that nothing of them grows in the driver.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import new_folder, small, stored, text_batches

LEAST_BYTES = 100
#: The time of captures that have none.
CAPTURED = "2024-01-01T00:00:00Z"
#: What orders captures: URL key, timestamp and page.
Key = tuple[str, str, str]
#: Runs that one task merges, rows of a run's batches, and keys that a run samples.
FAN_IN, BATCH, SAMPLES = 64, 1024, 64
ENTRY = "urlkey string, ts string, page_id string, file string, offset long, length long"
NAMES = ["urlkey", "ts", "page_id", "file", "offset", "length"]
_RUN = pa.schema([*((n, pa.string()) for n in NAMES[:4]), *((n, pa.int64()) for n in NAMES[4:])])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then the path; scheme, port and leading www are dropped."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}" if m else f"){(url or '').strip()}"


def record(page_id: str, url: str | None, ts: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record if it refers to another page."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    more = "" if refers_to is None else f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: {_PROFILE}\r\n"
    block = http + payload if refers_to is None else http
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Date: {ts}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[str, int, str, str, str | None]:
    """page_id, payload bytes, payload digest, type and the page that it refers to; a response's payload is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {page('WARC-Record-ID')} is damaged")
    return page("WARC-Record-ID"), length, digest, fields["WARC-Type"], page("WARC-Refers-To")


class LoserTree:
    """k-way merge of sorted iterators of tuples: inner nodes hold the losers of their matches, so a row costs log2 k of them."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * len(self.runs)
        for i in range(len(self.runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its match
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[top := self.losers[0]]) is not None:
            yield head
            self.heads[top] = next(self.runs[top], None)
            self._play(top)


def _write_run(fs, path: str, rows: Iterable[tuple]) -> tuple[int, list[Key]]:
    """Number of rows and sampled keys of a run written from sorted rows."""
    n, sample, held = 0, [], []
    step = 1
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, _RUN) as writer:

        def flush() -> None:
            if held:
                writer.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _RUN.types, strict=True)], schema=_RUN))
                held.clear()

        for row in rows:
            if n % step == 0:
                sample.append(tuple(row[:3]))
                if len(sample) >= 2 * SAMPLES:  # half of them, from now on half as often
                    sample, step = sample[::2], step * 2
            n += 1
            held.append(row)
            if len(held) == BATCH:
                flush()
        flush()
    return n, sample


def _read_run(fs, path: str, low: Key | None, high: Key | None) -> Iterator[tuple]:
    """Rows of a run with low <= key < high; batches before low are found by bisection and not read."""
    with fs.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        key = lambda b: tuple(reader.get_batch(b).column(c)[0].as_py() for c in range(3))
        first = 0 if low is None else max(0, bisect_left(range(reader.num_record_batches), low, key=key) - 1)
        for b in range(first, reader.num_record_batches):
            for row in zip(*(c.to_pylist() for c in reader.get_batch(b).columns), strict=True):
                if high is not None and row[:3] >= high:
                    return
                if low is None or row[:3] >= low:
                    yield row


def plan_records(pages: DataFrame, captured: Column) -> DataFrame:
    """page_id (string, empty for none), url, html, ts, digest and refers_to of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    ts = F.coalesce(captured.cast("string"), F.lit(CAPTURED))
    rows = pages.select("page_id", "url", html.alias("html"), ts.alias("ts"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"))
    first = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first")
    joined = rows.join(small(stored(first, "payloads")), "digest", "left")
    refers = F.when((F.col("bytes") >= LEAST_BYTES) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first").cast("string"))
    return joined.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "url", "html", "ts", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, captured: Column | None = None) -> DataFrame:
    """Writes archives and runs of pages (page_id, url, html) and returns a table of the path, n (rows) and sample (keys) of each run.

    Null and empty htmls are records of no bytes; an empty table gives no runs.
    captured is the time of each page as WARC writes it; without it, and where it is null, a page has the time CAPTURED.
    """

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, offset, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if out is None and len(batch):
                fs.create_dir(base)
                out = fs.open_output_stream(posixpath.join(base, name), compression=None)
            rows = []
            for x in batch.itertuples():
                refers = x.refers_to if isinstance(x.refers_to, str) else None
                url = x.url if isinstance(x.url, str) else None
                data = gzip.compress(record(x.page_id, url, x.ts, x.html.encode(), x.digest, refers), 1, mtime=0)
                out.write(data)
                rows.append((url_key(url), x.ts, x.page_id, name, offset, len(data)))
                offset += len(data)
            yield pd.DataFrame(rows, columns=NAMES)
        if out is not None:
            out.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        path = posixpath.join(base, f"{uuid.uuid4().hex}.run")
        fs.create_dir(base)
        n, sample = _write_run(fs, path, (r for b in batches for r in b.itertuples(index=False, name=None)))
        yield pd.DataFrame([(path, n, sample)], columns=["path", "n", "sample"])

    entries = plan_records(text_batches(pages), F.lit(None) if captured is None else captured).mapInPandas(archive, ENTRY).sortWithinPartitions(*NAMES)
    return stored(entries.mapInPandas(run, "path string, n long, sample array<array<string>>").where("n > 0"), "runs")


def _put(folder: str, value) -> str:
    """The path of a JSON file in the folder: what many tasks share is not sent with each."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    path = posixpath.join(base, f"{uuid.uuid4().hex}.json")
    with fs.open_output_stream(path) as out:
        out.write(json.dumps(value).encode())
    return path


def _get(fs, path: str):
    with fs.open_input_stream(path) as source:
        return json.loads(source.read())


def _cuts(runs: DataFrame, ranges: int) -> list[Key]:
    """Keys that cut what the runs hold into so many ranges: Spark ranges the sampled keys, and the driver has a key a range, however many runs there are."""
    keys = runs.select(F.explode("sample").alias("k"))
    lows = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect()
    return sorted(tuple(r["k"]) for r in lows)[1:]


def _groups(runs: DataFrame, folder: str) -> DataFrame:
    """r and file of groups of at most FAN_IN runs (r, path) of one range; the file lists the group's paths."""
    fan = FAN_IN

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[str]] = {}
        for batch in batches:
            for r, path in zip(batch["r"].tolist(), batch["path"], strict=True):
                held.setdefault(r, []).append(path)
                if len(held[r]) == fan:
                    yield pd.DataFrame([(r, _put(folder, held.pop(r)))], columns=["r", "file"])
        yield pd.DataFrame([(r, _put(folder, paths)) for r, paths in held.items()], columns=["r", "file"])

    # runs of all ranges may be grouped anyhow, so they are dealt evenly, as many to a task as make 16 groups; those of a range stay together
    dealt = runs.repartition(-(-max(1, runs.where("r < 0").count()) // (16 * fan))) if runs.where("r >= 0").isEmpty() else runs.repartition("r")
    return stored(dealt.mapInPandas(deal, "r int, file string"), "groups-of-runs")


def merged_index(spark: SparkSession, folder: str, runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The entries of all runs (path, n, sample); partitions are ranges of (URL key, timestamp, page) in order, each sorted by it.

    The first pass merges whole runs, which are small; later ones merge what groups of runs have in one range. Runs and groups
    are rows of tables: the driver holds the cuts of the ranges and counts, and a task the paths of its group. No runs give no entries.
    """
    cuts = _cuts(runs, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = len(cuts) + 1
    bounds = _put(folder, [None, *cuts, None])

    def rows(fs, r: int, file: str) -> Iterator[tuple]:
        low, high = (None, None) if r < 0 else (None if k is None else tuple(k) for k in _get(fs, bounds)[r : r + 2])
        return iter(LoserTree(_read_run(fs, p, low, high) for p in _get(fs, file)))

    def to_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in batch.itertuples():
                path = posixpath.join(base, f"{uuid.uuid4().hex}.run")
                _write_run(fs, path, rows(fs, x.r, x.file))
                yield pd.DataFrame([(x.r, path)], columns=["r", "path"])

    def to_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in batch.itertuples():
                merged = rows(fs, x.r, x.file)
                while held := list(islice(merged, 8 * BATCH)):
                    yield pd.DataFrame(held, columns=NAMES)

    def by_range(groups: DataFrame) -> DataFrame:
        every = F.when(F.col("r") < 0, F.sequence(F.lit(0), F.lit(ranges - 1))).otherwise(F.array("r"))
        return groups.select(F.explode(every).alias("r"), "file")

    groups = _groups(runs.select(F.lit(-1).alias("r"), "path"), folder)
    first, most = True, groups.count()
    while most > 1:
        tasks = groups.repartitionByRange(most, "file") if first else by_range(groups).repartitionByRange(ranges, "r", "file")
        made = stored(tasks.mapInPandas(to_run, "r int, path string"), "merged-runs")
        groups = _groups(made, folder)
        first, most = False, groups.groupBy("r").count().agg(F.max("count")).first()[0]
    return by_range(groups).repartitionByRange(ranges, "r").mapInPandas(to_rows, ENTRY)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the index, from the archives; an empty index gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(posixpath.join(base, file))
                source.seek(offset)
                out.append(parse_record(zlib.decompress(source.read(length), 31)))
            yield pd.DataFrame(out, columns=names)
        if source is not None:
            source.close()

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # an entry is a few bytes but stands for a record, so the number is given: Spark would join partitions by the entries' size
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "length").repartition(tasks, "file").sortWithinPartitions("file", "offset")
    read = placed.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.withColumns({"page_id": F.nullif(F.col("page_id"), F.lit("")).cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, captured: Column | None = None) -> DataFrame:
    """Writes pages to archives and returns what read_archives() reads from them through the merged index.

    A null html counts as empty, a null url as about:blank. Of equal payloads of at least 100 bytes the smallest page_id is
    the response (rows that repeat that id are all responses), and the others revisit it; a page without an id revisits,
    but nothing refers to it. A page without a time (captured) has the time CAPTURED. Repeated rows each get a record. Other columns are ignored; an empty table gives no rows.
    """
    folder = folder or new_folder(spark, "warc")
    return read_archives(merged_index(spark, folder, write_archives(pages, folder, captured)), folder)
