"""Exported diaries as a data source: ``spark.read.format("diary_export")``.

    spark.dataSource.register(DiaryExport)
    spark.read.format("diary_export").option("table", "check_in").load("file:///exports")

A file holds one document, or one a line; files are dealt to partitions by size, and each is parsed where it is read, a
document at a time. The path may be any that ``pyarrow.fs`` opens (file, hdfs, s3, gs). ``table``: ``check_in``, ``daily_metric``, or
``problems``, what could not be read: (document, position, error).

Documents are known as file name and line number. Unknown fields are ignored, missing optional fields are null. A
document that is no JSON object, has another schemaVersion than 1, or lists that are none, gives one problem and no rows;
a row without its required fields, or with a value of another kind, gives one problem, and the rest of its document is
read. ``mode`` ``FAILFAST`` raises at the first problem instead. Empty files and blank lines hold no document.
"""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of files in a partition, about.
PARTITION = 32 << 20
#: Bytes that are read at once.
BLOCK = 1 << 20
SUFFIXES = (".json", ".jsonl", ".txt")
TABLES = {
    "check_in": "document STRING, position INT, ts TIMESTAMP, zone_id STRING, day DATE, mood INT, energy INT, note STRING, tags ARRAY<STRING>",
    "daily_metric": "document STRING, position INT, day DATE, screen_minutes DOUBLE, social_media_minutes DOUBLE, late_night_screen_minutes DOUBLE, unlock_count INT, sleep_minutes DOUBLE, sleep_source STRING, steps DOUBLE, exercise_minutes DOUBLE, resting_hr DOUBLE, hrv DOUBLE",
    "problems": "document STRING, position INT, error STRING",
}


def _whole(v: Any) -> int:
    if isinstance(v, bool) or not (isinstance(v, int) or isinstance(v, float) and v.is_integer()):
        raise ValueError(f"no whole number: {v!r}")
    return int(v)


def _int(v: Any) -> int:
    if not -(1 << 31) <= _whole(v) < 1 << 31:
        raise ValueError(f"too large: {v!r}")
    return int(v)


def _number(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise ValueError(f"no number: {v!r}")
    return float(v)


def _text(v: Any) -> str:
    if not isinstance(v, str):
        raise ValueError(f"no text: {v!r}")
    return v


def _texts(v: Any) -> list[str]:
    if not isinstance(v, list):
        raise ValueError(f"no list: {v!r}")
    return [_text(x) for x in v]


def _date(v: Any) -> dt.date:
    return dt.date.fromisoformat(_text(v))


def _instant(v: Any) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=_whole(v))


# The document's lists and the names of their fields, with the column's place in the table; * is required.
LISTS: dict[str, tuple[str, tuple[tuple[str, Callable[[Any], Any]], ...]]] = {
    "check_in": ("checkIns", (("timestampUtc*", _instant), ("zoneId*", _text), ("localDate*", _date), ("mood*", _int), ("energy*", _int), ("note", _text), ("tags", _texts))),
    "daily_metric": (
        "dailyMetrics",
        (
            ("localDate*", _date), ("screenMinutes", _number), ("socialMediaMinutes", _number), ("lateNightScreenMinutes", _number), ("unlockCount", _int), ("sleepMinutes", _number), ("sleepSource", _text), ("steps", _number),
            ("exerciseMinutes", _number), ("restingHeartRate", _number), ("hrv", _number),
        ),
    ),
}


def parsed(name: str, text: str, table: str) -> Iterator[tuple[tuple | None, tuple | None]]:
    """(row, None) or (None, problem) for each element of a document's list."""
    try:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise ValueError("no object")
        if doc.get("schemaVersion", 1) != 1:
            raise ValueError(f"schemaVersion {doc['schemaVersion']!r}")
        rows = doc.get(LISTS[table][0])
        rows = [] if rows is None else rows
        if not isinstance(rows, list):
            raise ValueError(f"{LISTS[table][0]} is no list")
    except (ValueError, RecursionError) as e:
        yield None, (name, None, str(e))
        return
    for k, row in enumerate(rows):
        try:
            if not isinstance(row, dict):
                raise ValueError("no object")
            out: list[Any] = []
            for field, read in LISTS[table][1]:
                value = row.get(field.rstrip("*"))
                if value is None and field.endswith("*"):
                    raise ValueError(f"no {field[:-1]}")
                out.append(([] if read is _texts else None) if value is None else read(value))
            yield (name, k, *out), None
        except (ValueError, OverflowError) as e:
            yield None, (name, k, f"{LISTS[table][0]}: {e}")


BOM = "\ufeff"


def _lines(stream: BinaryIO) -> Iterator[tuple[int, str]]:
    """(number, text) of the lines that are not blank, one at a time."""
    for k, raw in enumerate(stream, 1):
        line = raw.decode("utf-8", "replace").removesuffix("\n")
        line = line.removeprefix(BOM) if k == 1 else line
        if line.strip():
            yield k, line


def _object_a_line(stream: BinaryIO) -> bool | None:
    """Whether there are several lines and each begins and ends an object; None without any line."""
    n = 0
    for n, (_, x) in enumerate(_lines(stream), 1):  # noqa: B007
        if not (x.lstrip().startswith("{") and x.rstrip().endswith("}")):
            return False
    return n > 1 if n else None


def documents(name: str, opened: Callable[[], BinaryIO]) -> Iterator[tuple[str, str]]:
    """(name, text) of the documents of a file: the whole, or each line where every one begins an object of its own.

    The file is gone through twice, and no more of it is held than one document.
    """
    with opened() as stream:
        by_line = _object_a_line(stream)
    if by_line is not None:
        with opened() as stream:
            if by_line:
                yield from ((f"{name}:{k}", x) for k, x in _lines(stream))
            else:
                yield name, stream.read().decode("utf-8", "replace").removeprefix(BOM)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):  # option names are in lower case
        self.table, self.strict = options.get("table", "check_in"), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.size, self.path = int(options.get("partitionbytes", PARTITION)), options["path"]
        from pyspark.sql.pandas.types import to_arrow_schema

        self.target = to_arrow_schema(schema)

    def _open(self):  # type: ignore[no-untyped-def]
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._open()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(SUFFIXES) and not f.base_name.startswith(("_", "."))]
        out: list[InputPartition] = []
        held: list[str] = []
        size = 0
        for f in sorted(found, key=lambda f: f.path):
            if held and size + f.size > self.size:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, *([Files(tuple(held))] if held else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = self._open()
        lists = list(LISTS) if self.table == "problems" else [self.table]
        for path in partition.paths:
            name = path.removeprefix(root).lstrip("/") or path.rsplit("/", 1)[-1]
            opened = lambda path=path: io.BufferedReader(system.open_input_stream(path), BLOCK)
            for document, text in documents(name, opened):
                taken, whole = [], set()
                for row, problem in (x for table in lists for x in parsed(document, text, table)):
                    if problem is not None and self.strict:
                        raise ValueError(f"{problem[0]}, {problem[1]}: {problem[2]}")
                    if self.table != "problems":
                        taken += [] if row is None else [row]
                    elif problem is not None and problem not in whole:
                        taken.append(problem)
                        if problem[1] is None:  # of the whole document, so each list has it
                            whole.add(problem)
                    if len(taken) == 4096:
                        yield self._batch(taken)
                        taken = []
                if taken:
                    yield self._batch(taken)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(self.target)], schema=self.target)


class DiaryExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "diary_export"

    def schema(self) -> str:
        table = self.options.get("table", "check_in")
        if table not in TABLES:
            raise ValueError(f"table: one of {', '.join(TABLES)}, not {table}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)
