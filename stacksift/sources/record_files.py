"""Files of records as Python data sources: lines read in byte ranges with bad ones kept, and a table whose writes are atomic.

``record_lines`` reads JSON lines or TSV. A line belongs to the range in which it begins, so a large file is read by
many tasks. Each row has its file and place; a line that does not fit the schema is a row of nulls with the line itself
in ``bad_line`` and the reason in ``bad_reason``, so what was skipped can be counted, listed and repaired.

``record_table`` is a folder of JSON lines with a log of commits. Tasks write files that nobody reads yet; only when all
have ended does the driver put one entry into the log, by a rename. Readers take the files that the log names. A write
that dies, or is aborted, leaves the table as it was; an overwrite takes effect in one step; a batch that has a name is
written once, however often it is tried. There may be one writer at a time.

Paths go through Arrow's file systems (local and shared folders, HDFS, object stores). What only Spark's own readers
can open is read with ``readers.json_lines`` instead.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
ROWS_A_BATCH = 10_000
MARK = b"\xef\xbb\xbf"
#: Columns that ``record_lines`` adds to the declared ones.
PLACE = "file string, at bigint, bad_line string, bad_reason string"
LOG = "_commits"


def _open(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    header: tuple = ()
    batch: str = ""


def _files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of the files of a folder that end so and are not hidden."""
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    name = lambda i: i.path.rpartition("/")[2]
    return sorted((i.path, i.size) for i in found if i.is_file and (info.is_file or (i.path.endswith(suffixes) and name(i)[0] not in "._")))


def _ranges(path: str, size: int, split: int, **more) -> list[Range]:
    return [Range(path, lo, min(lo + split, size), **more) for lo in range(0, size, split)]


def lines_in(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin from ``start`` to before ``end``; line ends are \\n or \\r\\n."""
    if start:
        stream.seek(start - 1)
    reader = io.BufferedReader(stream, 1 << 20)
    at = start
    if start:
        at += len(reader.readline()) - 1  # what is left of a line that began before; nothing if the range begins with one
    while at < end and (line := reader.readline()):
        yield at, line.rstrip(b"\r\n")
        at += len(line)


class _Lines(DataSourceReader):
    def __init__(self, schema: StructType, options, table: bool = False):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.kind, self.table = options["path"], options.get("kind", "json"), table
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.least = int(options.get("leastcolumns", 1))
        self.arrow = to_arrow_schema(schema)
        self.own = [f.name for f in schema if table or f.name not in ("file", "at", "bad_line", "bad_reason")]

    def partitions(self) -> list[Range]:
        if self.table:
            return [r for batch, file, size in committed(self.path) for r in _ranges(file, size, self.split, batch=batch)] or [Range("", 0, 0)]
        out = []
        for path, size in _files(self.path, (".jsonl", ".json", ".txt") if self.kind == "json" else (".tsv", ".txt", ".csv")):
            header = ()
            if self.kind == "tsv":
                with _open(self.path)[0].open_input_file(path) as f:
                    first = next((line for _, line in lines_in(f, 0, 1)), b"")
                header = tuple(first.removeprefix(MARK).decode().split("\t"))
                if len(header) < self.least:
                    raise ValueError(f"{path}: {len(header)} columns, {self.least} expected")
            out += _ranges(path, size, self.split, header=header)
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        rows: list[tuple] = []
        with _open(self.path)[0].open_input_file(part.path) as f:
            for at, line in lines_in(f, part.start, part.end):
                body = line.removeprefix(MARK) if at == 0 else line
                if not body.strip() or (self.kind == "tsv" and at == 0):
                    continue
                rows.append((at, body.decode("utf-8", "replace"), *self._parsed(body, part.header)))
                if len(rows) == ROWS_A_BATCH:
                    yield self._batch(rows, part)
                    rows = []
        if rows:
            yield self._batch(rows, part)

    def _parsed(self, line: bytes, header: tuple) -> tuple[dict, str | None]:
        try:
            if self.kind == "json":
                made = json.loads(line)
                return (made, None) if isinstance(made, dict) else ({}, "no object")
            cells = line.decode().split("\t")
            return (dict(zip(header, cells, strict=False)), None) if len(cells) >= self.least else ({}, "few columns")
        except ValueError:
            return {}, "no json" if self.kind == "json" else "no text"

    def _cells(self, value, kind: pa.DataType):
        """A value as the column has it; of text, numbers are read."""
        if value is None or (value == "" and not pa.types.is_string(kind)):
            return None
        if pa.types.is_string(kind):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(value, str) and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
            value = int(value) if pa.types.is_integer(kind) else float(value)
        if pa.types.is_floating(kind) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if isinstance(value, bool) != pa.types.is_boolean(kind):
            raise ValueError("other type")
        return pa.scalar(value, kind).as_py()

    def _batch(self, rows: list[tuple], part: Range) -> pa.RecordBatch:
        kinds = {f.name: f.type for f in self.arrow}
        columns: dict[str, list] = {n: [] for n in kinds}
        for at, line, made, reason in rows:
            cells = {}
            try:
                cells = {n: self._cells(made.get(n), kinds[n]) for n in self.own if n != "batch" or not self.table}
            except (ValueError, TypeError, pa.ArrowException):
                reason = reason or "other type"
            if self.table and reason:
                raise ValueError(f"{part.path} at {at}: {reason}")
            cells = {} if reason else cells
            place = {"batch": part.batch} if self.table else {"file": part.path, "at": at, "bad_line": line if reason else None, "bad_reason": reason}
            for n, values in columns.items():
                values.append(place[n] if n in place else cells.get(n))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.arrow], schema=self.arrow)


class RecordLines(DataSource):
    """Options: path (file or folder), kind (json or tsv), fields (a schema), splitBytes, leastColumns."""

    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return f"{self.options['fields']}, {PLACE}"

    def reader(self, schema: StructType) -> _Lines:
        return _Lines(schema, self.options)


# --- a table with a log ----------------------------------------------------------------------------------------------
def _entries(path: str) -> list[dict]:
    """The log's entries, oldest first."""
    from pyarrow import fs

    system, at = _open(path)
    if system.get_file_info(f"{at}/{LOG}").type == fs.FileType.NotFound:
        return []
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(f"{at}/{LOG}")) if i.path.endswith(".json"))
    out = []
    for f in found:
        with system.open_input_file(f) as s:
            out.append(json.loads(s.read()))
    return out


def committed(path: str) -> list[tuple[str, str, int]]:
    """(batch, file, bytes) of what a reader of the table sees: entries from the last that replaced all before it."""
    live: list[dict] = []
    for e in _entries(path):
        live = [e] if e["replaces"] else [*live, e]
    return [(e["batch"], f, n) for e in live for f, n in e["files"]]


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)
    rows: int = 0


class _Commit(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex
        self.batch = options.get("batch") or self.job
        self.names = [f.name for f in schema]

    def _known(self) -> bool:
        return any(e["batch"] == self.batch for e in _entries(self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        done, out = Written(), None
        name = f"{at}/part-{self.job}-{uuid.uuid4().hex}.jsonl"  # a task that runs again writes another file
        try:
            for b in iterator:
                if out is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(name)
                rows = b.rename_columns(self.names).to_pylist()
                out.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in rows).encode())
                done.rows += len(rows)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.files.append((name, system.get_file_info(name).size))
        return done

    def commit(self, messages: list) -> None:
        if self._known():
            self.abort(messages)
            return
        system, at = _open(self.path)
        system.create_dir(f"{at}/{LOG}", recursive=True)
        seen = _entries(self.path)
        entry = {"batch": self.batch, "replaces": self.overwrite, "rows": sum(m.rows for m in messages if m), "files": [f for m in messages if m for f in m.files]}
        draft = f"{at}/{LOG}/.{self.job}"
        with system.open_output_stream(draft) as s:
            s.write(json.dumps(entry).encode())
        system.move(draft, f"{at}/{LOG}/{len(seen):012d}.json")

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for f, _ in m.files if m else ():
                system.delete_file(f)


class RecordTable(DataSource):
    """Options: path; for reading fields (a schema, to which the batch is added); for writing batch (a name, written once)."""

    @classmethod
    def name(cls) -> str:
        return "record_table"

    def schema(self) -> str:
        return f"{self.options['fields']}, batch string"

    def reader(self, schema: StructType) -> _Lines:
        return _Lines(schema, self.options, table=True)

    def writer(self, schema: StructType, overwrite: bool) -> _Commit:
        return _Commit(self.options, schema, overwrite)


def _source(spark: SparkSession, kind: type[DataSource]) -> str:
    spark.dataSource.register(kind)
    return kind.name()


def read_lines(spark: SparkSession, path: str, fields: str, *, kind: str = "json", least_columns: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All lines of a file or folder: the declared fields, file, at, and for bad ones bad_line and bad_reason."""
    reader = spark.read.format(_source(spark, RecordLines)).option("fields", fields).option("kind", kind)
    return reader.option("leastColumns", least_columns).option("splitBytes", split_bytes).load(path)


def line_counts(lines: DataFrame) -> DataFrame:
    """file, n_read, n_bad and the bad lines by reason, as a report of a scan."""
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    counts = lines.groupBy("file", F.coalesce("bad_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.groupBy("file").agg(F.sum(F.when(F.col("reason") == "", F.col("n")).otherwise(0)).alias("n_read"), F.sum(F.when(F.col("reason") != "", F.col("n")).otherwise(0)).alias("n_bad"), F.to_json(F.map_filter(by, lambda k, _: k != "")).alias("reasons"))


def write_batch(df: DataFrame, path: str, batch: str | None = None, *, replace: bool = False) -> None:
    """One atomic write: appended, or in place of all that is there; a named batch that is in the log already does nothing."""
    out = df.write.format(_source(df.sparkSession, RecordTable)).mode("overwrite" if replace else "append")
    (out.option("batch", batch) if batch else out).save(path)


def read_table(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """What the log names, with each row's batch."""
    return spark.read.format(_source(spark, RecordTable)).option("fields", fields).load(path)


def batches(path: str) -> list[dict]:
    """The log: batch, replaces, rows, files of every commit, oldest first."""
    return _entries(path)
