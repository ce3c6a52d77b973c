"""Files as a sink: a file of its own for each row (name, body), written by tasks and committed together.

A task writes into a folder of its own below the target. The commit is one small JSON file that lists the folders of the tasks that
succeeded, with the numbers of files, bytes and missing ids, so a task that is run again, or a job that fails, leaves nothing that a
reader sees. What the driver gets is one message for each task.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.operators.batches import text_batches

COMMIT = "_COMMIT.json"
#: The name of the list of missing ids in a task's folder, and bytes that a file's name may have.
MISSING, NAME_BYTES = "~missing-ids.txt", 240
#: Files and bytes that a batch of read files has at most, but for the last file, which may be of any size.
READ_FILES, READ_BYTES = 500, 1 << 22


@dataclass
class TaskFiles(WriterCommitMessage):
    folder: str
    files: int
    size: int
    missing: int


def short_name(name: str) -> str:
    """A name as it is if a file system takes it; a longer one is cut, with a hash of the whole before its extension."""
    if len(name.encode()) <= NAME_BYTES:
        return name
    stem, dot, end = name.rpartition(".")
    stem, end = (stem, dot + end) if dot and len(end.encode()) < 20 else (name, "")
    mark = "-" + hashlib.sha1(name.encode()).hexdigest()[:12]
    return stem.encode()[: NAME_BYTES - len((mark + end).encode())].decode(errors="ignore") + mark + end


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        fs, base = pafs.FileSystem.from_uri(self.path)
        folder = f"task-{uuid.uuid4().hex}"
        done = TaskFiles(folder, 0, 0, 0)
        missing = []
        for batch in iterator:
            if batch.num_rows:
                fs.create_dir(posixpath.join(base, folder))
            for name, body in zip(batch.column("name"), batch.column("body"), strict=True):
                if not body.is_valid:
                    missing.append(name.as_py() or "")
                    continue
                data = body.as_py().encode()
                with fs.open_output_stream(posixpath.join(base, folder, short_name(name.as_py() or "_"))) as out:
                    out.write(data)
                done.files, done.size = done.files + 1, done.size + len(data)
        if missing:
            with fs.open_output_stream(posixpath.join(base, folder, MISSING)) as out:
                out.write("".join(f"{x}\n" for x in missing).encode())
            done.missing = len(missing)
        return done

    def commit(self, messages: list[TaskFiles | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        done = [m for m in messages if m is not None and m.files + m.missing]
        said = {"folders": sorted(m.folder for m in done), **{k: sum(getattr(m, k) for m in done) for k in ("files", "size", "missing")}}
        old = committed(self.path)
        if old and not self.overwrite:
            said = {"folders": sorted({*old["folders"], *said["folders"]}), **{k: old[k] + said[k] for k in ("files", "size", "missing")}}
        fs.create_dir(base)
        with fs.open_output_stream(posixpath.join(base, COMMIT)) as out:
            out.write(json.dumps(said).encode())
        for folder in set(old["folders"] if old else []) - set(said["folders"]):
            fs.delete_dir(posixpath.join(base, folder))

    def abort(self, messages: list[TaskFiles | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(posixpath.join(base, m.folder)).type != pafs.FileType.NotFound:
                fs.delete_dir(posixpath.join(base, m.folder))


class FilesSource(DataSource):
    """Format lectern_files: rows (name, body) to files below the path; a row without a body tells a missing id by its name."""

    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def committed(path: str) -> dict | None:
    """What the last commit below a path says; None if there is none."""
    fs, base = pafs.FileSystem.from_uri(path)
    at = posixpath.join(base, COMMIT)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def write_files(files: DataFrame, path: str, missing: DataFrame | None = None, mode: str = "append") -> dict:
    """Writes files (name, body) below a path (a URI), and the ids of missing (id) as lists beside them; gives what the commit says.

    Names must be unique, as names of a batch are. A null name is _, a name that is too long is cut (short_name()). Without rows the
    commit says so. mode overwrite removes what earlier commits wrote, append adds to it.
    """
    files.sparkSession.dataSource.register(FilesSource)
    rows = text_batches(files).select("name", F.coalesce("body", F.lit("")).alias("body"))
    if missing is not None:
        rows = rows.unionByName(missing.select(F.col("id").cast("string").alias("name"), F.lit(None).cast("string").alias("body")))
    rows.write.format("lectern_files").mode(mode).option("path", path).save()
    return committed(path)


def _read(spark: SparkSession, path: str, wanted: bool, names: list[str]) -> DataFrame:
    """name and body of the files of all committed folders that are lists of missing ids, or those that are not; a folder is read by one task.

    Spark's own readers leave out names that begin with a dot or a low line.
    """
    said = committed(path) or {"folders": []}
    rows = spark.createDataFrame([(f,) for f in said["folders"]], "folder string")
    dealt = rows.repartition(max(1, len(said["folders"])))

    def gathered(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([n for n, _ in held], pa.string()), pa.array([d for _, d in held], pa.binary()).cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for folder in (x for batch in batches for x in batch.column(0).to_pylist()):
            found = [x for x in fs.get_file_info(pafs.FileSelector(posixpath.join(base, folder))) if (posixpath.basename(x.path) == MISSING) == wanted]
            held, size = [], 0
            for info in sorted(found, key=lambda x: x.path):
                with fs.open_input_stream(info.path) as f:
                    data = f.read()
                held.append((posixpath.basename(info.path), data))
                size += len(data)
                if len(held) == READ_FILES or size >= READ_BYTES:
                    yield gathered(held)
                    held, size = [], 0
            if held:
                yield gathered(held)

    return dealt.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name and body of the files that commits below a path list."""
    return _read(spark, path, False, ["name", "body"])


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    """id of each missing document that commits below a path list."""
    lists = _read(spark, path, True, ["name", "ids"])
    return lists.select(F.explode(F.split(F.regexp_replace("ids", "\n$", ""), "\n")).alias("id"))
