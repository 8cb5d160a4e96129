"""Files of many documents, read a document at a time."""

import io
import json
import tracemalloc

import pytest
from pyspark.sql.types import StructType

from tideline.sources.imports import TABLES, Files, _Reader, documents


def plain(name, data):
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    lines = [(k, x) for k, x in enumerate(text.split("\n"), 1) if x.strip()]
    if len(lines) > 1 and all(x.lstrip().startswith("{") and x.rstrip().endswith("}") for _, x in lines):
        return [(f"{name}:{k}", x) for k, x in lines]
    return [(name, text)] if lines else []


@pytest.mark.parametrize(
    "data",
    [
        b"", b"\n \n", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n\n", b"{}", b"{}\n", b"\n{}\n{}", b"{}\r\n\r\n{}\r\n", b"\xef\xbb\xbf{}\n{}\n", b"{}\n\xef\xbb\xbf{}\n", b'{"a":\n{"b": 1}}\n', b"{}\n[]\n", b"{}\nx",
        b"\xc2\xa0{}\xc2\xa0\n\xe2\x80\x83\n {}\t\n", b'{"a": "\xff"}\n{"b": "\xe2\x82"}\n{\xe2\x82', b'{"a": "\xe2\x82\n"}', b"{}\x0b{}\x0c\n{}\x1c\n\x1d\n", '{"a": " "}\n{"b": "\x85"}\n'.encode(), b"}\n{", b"{\n}",
    ],
)
def test_documents_are_those_of_the_whole_text(data):
    assert list(documents("f", lambda: io.BytesIO(data))) == plain("f", data)


def test_a_file_is_never_held_whole(spark, tmp_path):
    """20 MB of documents of some 10 KB each are read in 8 MB; the whole file and its lines were held before."""
    row = {"timestampUtc": 0, "zoneId": "UTC", "localDate": "1970-01-01", "mood": 1, "energy": 2, "note": None, "tags": ["x"]}
    document = json.dumps({"schemaVersion": 1, "checkIns": [row] * 80}) + "\n"
    (tmp_path / "many.txt").write_text(document * (20_000_000 // len(document)))
    reader = _Reader({"path": str(tmp_path), "table": "check_in"}, StructType.fromDDL(TABLES["check_in"]))
    (part,) = reader.partitions()
    assert part == Files((f"{tmp_path}/many.txt",))
    next(reader.read(part))
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in reader.read(part))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 80 * (20_000_000 // len(document)) and peak < 8_000_000
