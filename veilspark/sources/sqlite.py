"""SQLite files as rows of cells, read in tasks from their bytes."""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = "db string, table_name string, column_name string, row_id long, value string, error string"


def _cells(name: str, content: bytes) -> Iterator[tuple]:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{os.path.abspath(f.name)}?mode=ro&immutable=1", uri=True)
        try:
            db.text_factory = lambda b: b.decode("utf-8", "ignore")
            tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'")]
            for table in tables:
                quoted = '"' + table.replace('"', '""') + '"'
                try:
                    columns = [r[1] for r in db.execute(f"PRAGMA table_xinfo({quoted})")]
                    wanted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
                    try:  # the row id of the table, where it has one that no column hides
                        rows = iter(db.execute(f"SELECT rowid, {wanted} FROM {quoted}")) if "rowid" not in map(str.lower, columns) else ((None, *r) for r in db.execute(f"SELECT {wanted} FROM {quoted}"))
                    except sqlite3.Error:
                        rows = ((None, *r) for r in db.execute(f"SELECT {wanted} FROM {quoted}"))
                    for n, (row_id, *row) in enumerate(rows):
                        i = n if row_id is None else row_id
                        for column, value in zip(columns, row, strict=True):
                            if isinstance(value, bytes):
                                for text in {value.decode("utf-8", "ignore"), value.decode("utf-16", "ignore")}:
                                    yield name, table, column, i, text, None
                            elif value is not None:
                                yield name, table, column, i, str(value), None
                except sqlite3.Error as e:
                    yield name, table, None, None, None, str(e)
        except sqlite3.Error as e:
            yield name, None, None, None, None, str(e)
        finally:
            db.close()


def sqlite_cells(found: DataFrame, batch: int = 5_000) -> DataFrame:
    """found: path, content. One row for each value that is not null, whatever its declared type; binary values as
    UTF-8 and UTF-16; what can't be read is a row with an error, never left out."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["db", "table_name", "column_name", "row_id", "value", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        lot: list[tuple] = []
        for frame in frames:
            for path, content in zip(frame.column("path").to_pylist(), frame.column("content").to_pylist(), strict=True):
                for cell in _cells(path, content or b""):
                    lot.append(cell)
                    if len(lot) == batch:
                        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in lot], t) for j, t in enumerate(types)], names=names)
                        lot = []
        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in lot], t) for j, t in enumerate(types)], names=names)

    return found.select("path", "content").mapInArrow(run, CELLS)


INVENTORY = "db string, table_name string, kind string, error string"
#: Ends of the names of the tables behind a full-text table.
_SHADOWS = ("_content", "_segments", "_segdir", "_docsize", "_stat", "_data", "_idx", "_config")


def _inventory(name: str, content: bytes) -> Iterator[tuple]:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{os.path.abspath(f.name)}?mode=ro&immutable=1", uri=True)
        try:
            made = db.execute("SELECT name, coalesce(sql, '') FROM sqlite_master WHERE type = 'table'").fetchall()
            full_text = {t: sql for t, sql in made if re.match(r"\s*CREATE\s+VIRTUAL\s+TABLE\b.*?\bUSING\s+fts[345]\b", sql, re.I | re.S)}
            for table, sql in made:
                base = next((b for b in full_text for end in _SHADOWS if table == b + end), None)
                if table in full_text:
                    empty = re.search(r"\bcontent\s*=\s*(['\"]?)\1\s*[,)]", sql, re.I)
                    yield name, table, "full_text", "a contentless index can't be read" if empty else None
                elif base:
                    yield name, table, "shadow", None
                else:
                    yield name, table, "system" if table.startswith("sqlite_") else "virtual" if re.match(r"\s*CREATE\s+VIRTUAL", sql, re.I) else "table", None
        except sqlite3.Error as e:
            yield name, None, None, str(e)
        finally:
            db.close()


def sqlite_inventory(found: DataFrame) -> DataFrame:
    """found: path, content. A row for each table: table, full_text, shadow (behind a full-text table), virtual or
    system; error where its content can't be looked into, or the file not be read."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = [r for path, content in zip(frame.column("path").to_pylist(), frame.column("content").to_pylist(), strict=True) for r in _inventory(path, content or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(4)], names=["db", "table_name", "kind", "error"])

    return found.select("path", "content").mapInArrow(run, INVENTORY)
