"""Cards of a bookmark service as a stream: a Python data source whose offset is the service's cursor (update time, card id).

The service lists cards after a cursor, a page at a time; a full page means that there may be more. A range of cursors is read in
slices of time, each by a task of its own that goes from page to page, so no task, and not the driver, reads all pages.
"""

from __future__ import annotations

import posixpath
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Cursor = tuple[int, str]
#: Before every card: update times are µs since 1970.
START: Cursor = (-(2**62), "")
#: Cards of a page at most.
MOST_CARDS = 20


class ReplayedCards:
    """A service that answers from a folder of Parquet files (id, update_time in µs, ...), written in the order of (update_time, id).

    Row groups are found by the statistics of their files, and a page is cut from one or two of them.
    """

    def __init__(self, path: str):
        self.path, self._index, self._held = path, None, None

    def index(self) -> list[tuple[Cursor, Cursor, str, int]]:
        """First and last cursor of each row group, its file and its place there, in order."""
        if self._index is None:
            fs, base = pafs.FileSystem.from_uri(self.path)
            found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
            self._index = []
            for info in found:
                if not info.path.endswith(".parquet") or posixpath.basename(info.path).startswith((".", "_")):
                    continue
                with fs.open_input_file(info.path) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.num_row_groups):
                        if file.metadata.row_group(g).num_rows:
                            keys = file.read_row_group(g, columns=["update_time", "id"]).slice
                            first, last = keys(0, 1).to_pylist()[0], keys(file.metadata.row_group(g).num_rows - 1, 1).to_pylist()[0]
                            self._index.append(((first["update_time"], first["id"]), (last["update_time"], last["id"]), info.path, g))
            self._index.sort()
        return self._index

    def __getstate__(self) -> dict:
        return {"path": self.path, "_index": None, "_held": None}

    def schema(self) -> pa.Schema:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(self.index()[0][2]) as f:
            return pq.ParquetFile(f).schema_arrow

    def first(self) -> Cursor | None:
        return self.index()[0][0] if self.index() else None

    def latest(self) -> Cursor | None:
        return max(x[1] for x in self.index()) if self.index() else None

    def _group(self, k: int) -> pa.Table:
        if self._held is None or self._held[0] != k:
            fs, _ = pafs.FileSystem.from_uri(self.path)
            _, _, path, g = self.index()[k]
            with fs.open_input_file(path) as f:
                self._held = (k, pq.ParquetFile(f).read_row_group(g))
        return self._held[1]

    def list_cards(self, cursor: Cursor, limit: int) -> tuple[pa.Table, bool]:
        """The next cards after a cursor, and whether there may be more: whether the page is full."""
        k = bisect_right([x[1] for x in self.index()], cursor)
        parts, n = [], 0
        while n < limit and k < len(self.index()):
            rows = self._group(k)
            later = pc.or_(pc.greater(rows["update_time"], cursor[0]), pc.and_(pc.equal(rows["update_time"], cursor[0]), pc.greater(rows["id"], cursor[1])))
            part = rows.filter(later).slice(0, limit - n)
            parts.append(part)
            n, k = n + len(part), k + 1
        page = pa.concat_tables(parts) if parts else self._group(0).slice(0, 0) if self.index() else pa.table({})
        return page, n == limit


@dataclass
class CardSlice(InputPartition):
    """Cards after one cursor up to another one."""

    after: Cursor
    up_to: Cursor


def _cursor(offset: dict) -> Cursor:
    return int(offset["update_time"]), offset["id"]


class CardStream(DataSourceStreamReader):
    def __init__(self, service, limit: int, slices: int):
        self.service, self.limit, self.slices = service, limit, slices

    def initialOffset(self) -> dict:
        return dict(zip(("update_time", "id"), START, strict=True))

    def latestOffset(self) -> dict:
        return dict(zip(("update_time", "id"), self.service.latest() or START, strict=True))

    def partitions(self, start: dict, end: dict) -> list[CardSlice]:
        after, up_to = _cursor(start), _cursor(end)
        if after >= up_to:
            return []
        low = max(after[0], (self.service.first() or after)[0])
        cuts = sorted({low + (up_to[0] - low) * i // self.slices for i in range(1, self.slices)})
        marks = [after, *[(t, "") for t in cuts if after < (t, "") < up_to], up_to]
        return [CardSlice(a, b) for a, b in zip(marks, marks[1:], strict=False)]

    def read(self, partition: CardSlice) -> Iterator[pa.RecordBatch]:
        cursor = partition.after
        while True:
            cards, more = self.service.list_cards(cursor, self.limit)
            if not len(cards):
                return
            keys = list(zip(cards["update_time"].to_pylist(), cards["id"].to_pylist(), strict=True))
            inside = cards.slice(0, bisect_right(keys, partition.up_to))
            told = inside.append_column("has_more", pa.array([more] * len(inside), pa.bool_()))
            yield from told.combine_chunks().to_batches()
            if not more or len(inside) < len(cards):
                return
            cursor = keys[-1]


def card_source(service, schema: StructType, name: str = "lectern_cards") -> type[DataSource]:
    """A data source of a service with first(), latest() and list_cards(); its rows have the service's columns and has_more.

    Options: limit, the cards of a page (MOST_CARDS at most), and slices, the tasks that read a range of cursors.
    """

    class Cards(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return StructType(schema.fields).add("has_more", "boolean")

        def streamReader(self, schema: StructType) -> CardStream:
            limit = min(int(self.options.get("limit", MOST_CARDS)), MOST_CARDS)
            return CardStream(service, max(1, limit), max(1, int(self.options.get("slices", 4))))

    return Cards


def write_replay(cards: DataFrame, path: str) -> None:
    """Cards (id, update_time in µs, ...) as a folder that ReplayedCards reads."""
    cards.where("id is not null and update_time is not null").repartitionByRange("update_time", "id").sortWithinPartitions("update_time", "id").write.mode("append").parquet(path)


def import_cards(spark: SparkSession, service, schema: StructType, target: str, checkpoint: str, limit: int = MOST_CARDS, slices: int = 4) -> StreamingQuery:
    """Appends the cards after the last run's cursor to target, each once: the checkpoint holds the cursor, the file sink its batches."""
    spark.dataSource.register(card_source(service, schema))
    stream = spark.readStream.format("lectern_cards").option("limit", limit).option("slices", slices).load()
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
