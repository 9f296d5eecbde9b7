"""Files per document, read and written by the tasks: a Python Data Source over path tables.

Reading. A directory of very many tiny files is slow to list and to plan on the driver. A path table (Parquet: id, path)
replaces the listing: ``document_files`` makes one partition of each row group of the table, whose footers are all
that the driver reads, and each task opens its own paths. A file that is missing or can't be decoded gives a row
with a null value and an ``error``, never a failed job.

Writing. ``document_files`` writes one file per row (folder, id, value) as the task reaches it: to a name of its own
first, then moved to the final name, so a reader never sees half a file and a repeated row replaces its file with
the same content. ``document_records`` appends Parquet part files (columns of the record, folder ``model=...``), each
committed by the task as soon as it is full or old enough. Neither needs the job to end: when a task, the job or the
driver dies, all that was committed stays. A task that runs again skips the ids that earlier attempts of it have
committed, and what only a lost attempt of a speculative pair wrote is removed when the job ends well.

Ids become file names with everything but letters, digits and ``-._ `` percent-encoded by UTF-8 byte, so that any id gives
a valid name and comes back unchanged.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scopekit.session import task_count

SAFE = "-._ "
PATHS_PER_FILE = 5_000
ROWS_PER_COMMIT = 256
SECONDS_PER_COMMIT = 30.0
READ_BYTES = 32 << 20           # content handed to Spark at once
CHUNK = 8 << 20                 # bytes of a file hashed at once


def file_name(doc_id: str, extension: str) -> str:
    name = quote(doc_id, safe=SAFE)
    if name[:1] in (".", "_"):          # names that readers skip as hidden
        name = f"%{ord(name[0]):02X}{name[1:]}"
    return name + extension


def id_of(path: str) -> str:
    """The id that ``file_name`` made a path's last segment from."""
    return unquote(re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1]))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or plain path; file, hdfs, s3 and gs as far as pyarrow supports them."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int


class PathTableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self):
        system, root = file_system(self.root)
        out = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    out += [RowGroup(info.path, i) for i in range(pq.ParquetFile(f).num_row_groups)]
        return sorted(out, key=lambda p: (p.file, p.group)) or [RowGroup("", -1)]

    def read(self, partition: RowGroup):
        system, _ = file_system(self.root)
        if partition.group < 0:
            return
        with system.open_input_file(partition.file) as f:
            table = pq.ParquetFile(f).read_row_group(partition.group, columns=["id", "path"])
        rows, size = [], 0
        for doc_id, path in zip(table.column("id").to_pylist(), table.column("path").to_pylist()):
            value, error = _content(path)
            rows.append((doc_id, path, value, error))
            size += len(value or "")
            if size >= READ_BYTES:
                yield _read_batch(rows)
                rows, size = [], 0
        if rows:
            yield _read_batch(rows)


def _content(path: str | None) -> tuple[str | None, str | None]:
    try:
        system, where = file_system(path)
        with system.open_input_stream(where) as f:
            return f.read().decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except FileNotFoundError:
        return None, "missing"
    except Exception as e:            # noqa: BLE001  an unreadable file is a row of the result
        return None, f"{type(e).__name__}"


def _read_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["id", "path", "value", "error"])


@dataclass
class Committed(WriterCommitMessage):
    partition: int
    attempt: int
    files: list


class FilePerRowWriter(DataSourceArrowWriter):
    """Rows (folder, id, value) -> <path>/<folder>/<id><extension>."""

    def __init__(self, options: dict):
        self.root, self.extension = options["path"], options.get("extension", ".json")

    def write(self, iterator):
        system, root = file_system(self.root)
        made, n = set(), 0
        for batch in iterator:
            for folder, doc_id, value in zip(*(batch.column(c).to_pylist() for c in ("folder", "id", "value"))):
                where = f"{root}/{quote(folder, safe=SAFE)}"
                if where not in made:
                    system.create_dir(where, recursive=True)
                    made.add(where)
                _moved(system, where, file_name(doc_id, self.extension), (value or "").encode())
                n += 1
        return Committed(-1, -1, [n])

    def commit(self, messages):
        pass

    def abort(self, messages):
        """Files of finished rows stay."""


def _moved(system: fs.FileSystem, folder: str, name: str, content: bytes) -> None:
    temporary = f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(content)
    system.move(temporary, f"{folder}/{name}")


class RecordsWriter(DataSourceArrowWriter):
    """Rows with ``model`` and ``id`` -> <path>/model=<model>/part-<job>-<partition>-<attempt>-<number>.parquet."""

    def __init__(self, options: dict):
        self.root, self.job = options["path"], uuid.uuid4().hex[:12]
        self.rows, self.seconds = int(options.get("rows", ROWS_PER_COMMIT)), float(options.get("seconds", SECONDS_PER_COMMIT))

    def _parts(self, system, root) -> list[tuple[str, int, int]]:
        """(path, partition, attempt) of this job's committed files."""
        out = []
        for folder in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if folder.type == fs.FileType.Directory and folder.base_name.startswith("model="):
                for info in system.get_file_info(fs.FileSelector(folder.path)):
                    m = re.fullmatch(rf"part-{self.job}-(\d+)-(\d+)-\d+\.parquet", info.base_name)
                    if m:
                        out.append((info.path, int(m[1]), int(m[2])))
        return out

    def write(self, iterator):
        from pyspark import TaskContext
        context = TaskContext.get()
        partition, attempt = context.partitionId(), context.attemptNumber()
        system, root = file_system(self.root)
        files, done = [], set()
        if attempt:                      # committed by earlier attempts of this partition
            for path, p, a in self._parts(system, root):
                if p == partition and a < attempt:
                    model = unquote(path.split("/model=")[-1].split("/")[0])
                    with system.open_input_file(path) as f:
                        done |= {(model, i) for i in pq.read_table(f, columns=["id"]).column("id").to_pylist()}
                    files.append(path)
        held, n, since = [], 0, time.monotonic()
        for batch in iterator:
            if done:
                keys = zip(batch.column("model").to_pylist(), batch.column("id").to_pylist())
                batch = batch.filter(pa.array([k not in done for k in keys], pa.bool_()))
            for start in range(0, batch.num_rows, self.rows):
                held.append(batch.slice(start, self.rows))
                n += held[-1].num_rows
                if n >= self.rows or time.monotonic() - since >= self.seconds:
                    files += self._commit_rows(system, root, held, f"{partition}-{attempt}-{len(files)}")
                    held, n, since = [], 0, time.monotonic()
        if n:
            files += self._commit_rows(system, root, held, f"{partition}-{attempt}-{len(files)}")
        return Committed(partition, attempt, files)

    def _commit_rows(self, system, root, held, number) -> list[str]:
        table = pa.Table.from_batches(held)
        models, paths = table.column("model"), []
        for model in sorted(set(models.to_pylist())):
            mine = table.filter(pa.compute.equal(models, model)).drop_columns(["model"])
            folder = f"{root}/model={quote(model, safe=SAFE)}"
            system.create_dir(folder, recursive=True)
            sink = pa.BufferOutputStream()
            pq.write_table(mine, sink)
            name = f"part-{self.job}-{number}.parquet"
            _moved(system, folder, name, sink.getvalue().to_pybytes())
            paths.append(f"{folder}/{name}")
        return paths

    def commit(self, messages):
        """The job ended well: files that no successful attempt names come from lost ones and go."""
        system, root = file_system(self.root)
        named = {path for m in messages if m for path in m.files}
        for path, _, _ in self._parts(system, root):
            if path not in named:
                system.delete_file(path)

    def abort(self, messages):
        """What was committed stays; the next run scores only what is missing."""


class DocumentFiles(DataSource):
    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return "id string, path string, value string, error string"

    def reader(self, schema):
        return PathTableReader(self.options)

    def writer(self, schema, overwrite):
        return FilePerRowWriter(self.options)


class DocumentRecords(DataSource):
    @classmethod
    def name(cls):
        return "document_records"

    def writer(self, schema, overwrite):
        return RecordsWriter(self.options)


def _registered(spark: SparkSession) -> None:
    from scopekit.operators.batch import ship_by_value
    ship_by_value()
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(DocumentRecords)


def write_path_table(paths: DataFrame, path_table: str, paths_per_file: int = PATHS_PER_FILE) -> None:
    """Store a path table from rows (id, path); ``paths_per_file`` paths are read by one task."""
    paths.select("id", "path").write.option("maxRecordsPerFile", paths_per_file).parquet(path_table)


def read_document_files(spark: SparkSession, path_table: str, value_name: str = "value") -> DataFrame:
    """(id, value, error) of every path in a path table; value is the whole text, null with an error."""
    _registered(spark)
    df = spark.read.format("document_files").option("path", path_table).load()
    return df.select("id", F.col("value").alias(value_name), "error")


def list_files(spark: SparkSession, folders: DataFrame, extension: str = ".json") -> DataFrame:
    """(id, path, length, modified) of the files with an extension below folders (folder), listed by the tasks; modified is in
    microseconds. A folder that doesn't exist has no files."""
    from scopekit.operators.batch import ship_by_value
    ship_by_value()

    def run(batches):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, where = file_system(folder)
                infos = [i for i in system.get_file_info(fs.FileSelector(where, allow_not_found=True))
                         if i.type == fs.FileType.File and i.base_name.endswith(extension) and not i.base_name.startswith("_")]
                for start in range(0, len(infos), 10_000):
                    some = infos[start:start + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_of(i.path) for i in some], pa.string()), pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in some], pa.string()),
                         pa.array([i.size for i in some], pa.int64()), pa.array([(i.mtime_ns or 0) // 1000 for i in some], pa.int64())],
                        names=["id", "path", "length", "modified"])
    return folders.select("folder").repartition(task_count(folders.sparkSession), "folder").mapInArrow(run, "id string, path string, length bigint, modified bigint")


def file_digests(paths: DataFrame) -> DataFrame:
    """The rows with ``sha256`` of the file at ``path``, read in chunks (a file of any size takes CHUNK bytes of memory);
    null where the file can't be read."""
    import hashlib

    from scopekit.operators.batch import ship_by_value
    ship_by_value()
    keep = [c for c in paths.columns if c != "sha256"]

    def digest(path):
        h = hashlib.sha256()
        try:
            system, where = file_system(path)
            with system.open_input_stream(where) as f:
                while chunk := f.read(CHUNK):
                    h.update(chunk)
        except Exception:             # noqa: BLE001  an unreadable file has no digest
            return None
        return h.hexdigest()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                found = pa.array([digest(p) for p in part.column("path").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*keep, "sha256"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.select(*keep).schema)
    return paths.select(*keep).repartition(task_count(paths.sparkSession), "path").mapInArrow(run, f"{schema}, sha256 string")


def write_document_files(df: DataFrame, root: str, extension: str = ".json") -> None:
    """Rows (folder, id, value) as one file each, durable one by one."""
    _registered(df.sparkSession)
    df.select("folder", "id", "value").write.format("document_files").mode("append").option("path", root).option("extension", extension).save()


def append_document_records(df: DataFrame, root: str, rows: int = ROWS_PER_COMMIT, seconds: float = SECONDS_PER_COMMIT) -> None:
    """Records (model, id, ...) in part files that are durable as soon as a task has filled them."""
    _registered(df.sparkSession)
    df.write.format("document_records").mode("append").option("path", root).option("rows", rows).option("seconds", seconds).save()
