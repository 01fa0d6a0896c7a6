"""Files that only a program can split: a task for each file, or more where it can.

Files that every machine can open are read by a Python data source, which streams
them; nothing but a bounded buffer is held. JSON and dumps of more than SPLIT bytes
are read in parts: one pass over the parts finds where values and statements start.
Files in other stores come through Spark, whole, to a task's own temporary file.
Rows come as (part, pos, cells): a part for each file or part of one, in the order
of names, and the file's own order.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabmend.sources import jsonsplit, sheet, sqldump, sqlitedb

SCHEMA = "part long, pos long, cells array<string>"
#: Bits of a place that number a file's rows; rows that a task passes on at once.
ROW_BITS, ROWS = 40, 1000
#: Bytes of a part of a file.
SPLIT = 16 << 20
#: Places in a dump that may be passed over, as they lie in texts, before the rest of it is one part.
AHEAD = 64


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def plain(path: str) -> str:
    """A local path without its scheme."""
    return path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path


def input_files(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files of a folder by name, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return [path]  # readers say what is wrong with it
    inside = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    return [plain(x) if is_local(path) else x for x in inside]


def first_file(spark: SparkSession, path: str) -> str:
    """A path by which the driver can open the first file; one in another store is copied."""
    first = (input_files(spark, path) or [path])[0]
    if is_local(first):
        return plain(first)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(first)
    copy = f"{tempfile.mkdtemp(prefix='tabmend-')}/{where.getName()}"
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyToLocalFile(where, jvm.org.apache.hadoop.fs.Path(copy))
    return copy


def rows_of(kind: str, path: str, table: str, span: dict | None = None) -> Iterator[list[str]]:
    """Rows of a file, or of the part of it that `span` says."""
    if kind == "sql":
        return sqldump.rows(path, table, **(span or {}))
    if kind == "sheet":
        return sheet.rows(path)
    if not span:
        return ([value] for value in jsonsplit.values(path))
    return ([value] for value in jsonsplit.values(path, span["kind"], jsonsplit.Piece(**span["piece"])))


def spans(spark: SparkSession, kind: str, files: list[str], table: str) -> list[tuple[int, str, int, dict | None]]:
    """(file, path, start, span) of each part, in order. What is found about a part is one small row."""
    sizes = [os.path.getsize(x) if os.path.isfile(x) else 0 for x in files]
    large = [i for i, n in enumerate(sizes) if n > SPLIT and (kind == "json" and jsonsplit.opening(files[i]) < SPLIT or kind == "sql" and table)]
    found = dict(zip(large, _split(spark, kind, [(files[i], sizes[i]) for i in large]), strict=True)) if large else {}
    out: list[tuple[int, str, int, dict | None]] = []
    for i, path in enumerate(files):
        out += [(i, path, start, span) for start, span in found.get(i, [(0, None)])]
    return out


def _split(spark: SparkSession, kind: str, files: list[tuple[str, int]]) -> list[list[tuple[int, dict]]]:
    edges = [[(at, min(at + SPLIT, n)) for at in range(0, n, SPLIT)] for _, n in files]
    tasks = [(i, path, *edge) for i, (path, _) in enumerate(files) for edge in edges[i]]

    def over(rows: list, f) -> list[list]:
        """f of every row, in tasks of their own, by file."""
        out: list[list] = [[] for _ in files]
        for i, x in spark.sparkContext.parallelize(rows, max(1, len(rows))).map(lambda r: (r[0], f(*r[1:]))).collect():
            out[i].append(x)
        return out

    if kind == "json":
        kinds = [jsonsplit.shape(path) for path, _ in files]
        tasks = [(i, path, start or jsonsplit.opening(path), stop) for i, path, start, stop in tasks]
        made = [jsonsplit.pieces(k, e, s) for k, e, s in zip(kinds, edges, over(tasks, jsonsplit.summary), strict=True)]
        return [[(p.start, {"kind": k, "piece": asdict(p)}) for p in pieces] for k, pieces in zip(kinds, made, strict=True)]
    likely = [[0, *dict.fromkeys(x for x in found if x is not None)] for found in over([x for x in tasks if x[2]], sqldump.likely_start)]
    follow = over([(i, path, start, likely[i][k + 1 : k + 1 + AHEAD]) for i, (path, _) in enumerate(files) for k, start in enumerate(likely[i])], sqldump.next_start)
    out = []
    for starts, ends in zip(likely, follow, strict=True):
        after, at, chain = dict(zip(starts, ends, strict=True)), 0, []
        while at is not None:  # from the file's start on, so that no part starts where no statement does
            chain.append((at, {"start": at, "stop": after[at]}))
            at = after[at]
        out.append(chain)
    return out


class _Piece(InputPartition):
    def __init__(self, part: int, args: dict) -> None:
        super().__init__(part)
        self.part, self.args = part, args


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Piece]:
        kind, path = self.options["kind"], self.options["path"]
        if kind == "sqlite":
            ranges = sqlitedb.row_ranges(path, self.options["table"], int(self.options.get("pieces", "8")))
            return [_Piece(i, {"low": low, "high": high}) for i, (low, high) in enumerate(ranges)]
        return [_Piece(i, {"file": f, "path": x, "start": start, "span": span}) for i, (f, x, start, span) in enumerate(json.loads(path))]

    def read(self, piece: _Piece):
        kind, path = self.options["kind"], self.options["path"]
        at = piece.part << ROW_BITS
        if kind == "sqlite":
            rows = sqlitedb.rows(path, self.options["table"], piece.args["low"], piece.args["high"])
        else:
            # a part has fewer rows than bytes, so its first byte's place is free for its first row
            at = (piece.args["file"] << ROW_BITS) + piece.args["start"]
            rows = rows_of(kind, piece.args["path"], self.options["table"], piece.args["span"])
        yield from _batches(piece.part, at, rows)


class CellFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabmend_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_cells(spark: SparkSession, kind: str, path: str, table: str = "", pieces: int = 8) -> DataFrame:
    if kind != "sqlite":
        files = input_files(spark, path)
        if not all(map(is_local, files)):
            return _through_spark(spark, kind, files, table)
        path = json.dumps(spans(spark, kind, [plain(x) for x in files], table))
    spark.dataSource.register(CellFiles)
    return spark.read.format("tabmend_cells").options(kind=kind, path=path, table=table, pieces=str(pieces)).load()


def _through_spark(spark: SparkSession, kind: str, files: list[str], table: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                with tempfile.TemporaryDirectory() as own:
                    path = Path(own) / "input"
                    path.write_bytes(content.as_buffer())
                    yield from _batches(part, part << ROW_BITS, rows_of(kind, str(path), table))

    parts = spark.createDataFrame([(i, x.rpartition("/")[2]) for i, x in enumerate(files)], "part long, name string")
    whole = spark.read.format("binaryFile").load(files).select(F.substring_index("path", "/", -1).alias("name"), "content").join(F.broadcast(parts), "name")
    return whole.select("part", "content").repartition(len(files), "part").mapInArrow(run, SCHEMA)


def _batches(part: int, at: int, rows: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
    held: list[list[str]] = []
    for cells in rows:
        held.append(cells)
        if len(held) == ROWS:
            yield _batch(part, at, held)
            held, at = [], at + ROWS
    if held:
        yield _batch(part, at, held)


def _batch(part: int, at: int, rows: list[list[str]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["part", "pos", "cells"])
