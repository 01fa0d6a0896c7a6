"""Delimited text: physical lines, decoding, quote repair, record assembly, tokenizing, header."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.config import DETECT_BYTES
from tabmend.functions import charset
from tabmend.operators.carrier import by_part_size, by_ranges, dealt, first_rows, place, with_order
from tabmend.operators.names import positional_names
from tabmend.operators.repair import drop_trailing, join_broken, realign
from tabmend.options import ConversionError, Options

BOM = "﻿"


def read_prefix(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, or of a folder's first file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        inside = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        if not inside:
            return b""
        where = jvm.org.apache.hadoop.fs.Path(inside[0])
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def physical_lines(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """(part, pos, value, n_fallback): lines as text, whatever their encoding; line feeds end them, carriage returns stay."""
    encoding = options.encoding
    encoding = charset.canonical(encoding) if encoding else charset.detect_encoding(read_prefix(spark, path, DETECT_BYTES))
    if encoding in charset.MULTI_BYTE and encoding != "utf-8":
        return _wide_lines(spark, path, charset.MULTI_BYTE[encoding])
    raw = with_order(spark.read.option("lineSep", "\n").text(path))
    data = F.col("value").cast("binary")
    if encoding != "utf-8":
        return raw.withColumn("value", charset.decode_single_byte(data, encoding)).withColumn("n_fallback", F.lit(0))
    value, bad = F.col("value"), F.lit(False)
    if options.fallback_encoding:
        bad = ~F.is_valid_utf8(value)
        value = F.when(bad, charset.decode_single_byte(data, charset.single_byte(options.fallback_encoding))).otherwise(value)
    else:
        value = F.make_valid_utf8(value)
    first = F.col("pos") == 0
    value = F.when(first & F.startswith(value, F.lit(BOM)), F.substring(value, F.lit(2), F.length(value))).otherwise(value)
    return raw.withColumn("n_fallback", bad.cast("int")).withColumn("value", value)


def _wide_lines(spark: SparkSession, path: str, codec: str) -> DataFrame:
    """Lines of files whose line feed is not one byte: decoded in bounded pieces, one task for each file."""

    def run(batches):
        import codecs

        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                decoder, rest, at = codecs.getincrementaldecoder(codec)("replace"), "", 0
                data = memoryview(content.as_buffer())
                for start in range(0, max(1, len(data)), 1 << 20):
                    piece = rest + decoder.decode(bytes(data[start : start + (1 << 20)]), start + (1 << 20) >= len(data))
                    if start == 0 and not at:
                        piece = piece.removeprefix(BOM)
                    *lines, rest = piece.split("\n")
                    if lines:
                        yield pa.record_batch([pa.array([part] * len(lines), pa.int64()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["part", "line", "value"])
                    at += len(lines)
                if rest:
                    yield pa.record_batch([pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([rest], pa.string())], ["part", "line", "value"])

    files = spark.read.format("binaryFile").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())  # a row for each file
    parts = by_part_size(spark.createDataFrame([(x, i) for i, x in enumerate(names)], "path string, part long"))
    files = files.select("path", "content").join(parts, "path").repartition(max(1, len(names)), "part")
    lines = files.select("part", "content").mapInArrow(run, "part long, line long, value string")
    return lines.select("part", F.struct("part", "line").alias("pos"), "value", F.lit(0).alias("n_fallback"))


def odd_quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def close_quotes(lines: DataFrame) -> DataFrame:
    """Lines with an odd number of quotes get one at their end, before a carriage return; n_quote counts them."""
    value = F.col("value")
    cr = F.endswith(value, F.lit("\r"))
    body = F.when(cr, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    closed = F.concat(body, F.lit('"'), F.when(cr, F.lit("\r")).otherwise(F.lit("")))
    odd = odd_quotes(value)
    return lines.withColumn("n_quote", odd.cast("int")).withColumn("value", F.when(odd, closed).otherwise(value))


def ends_open(text: str, delimiter: str, inside: bool) -> bool:
    """Whether a line feed after this text would stand inside quotes. inside: whether the text starts there.

    A quote opens a field only at its start; a doubled one inside stands for itself.
    """
    at, n = 0, len(text)
    start = not inside
    while at < n:
        if inside:
            at = text.find('"', at)
            if at < 0:
                return True
            if text.startswith('""', at):
                at += 2
                continue
            inside, start, at = False, False, at + 1
            continue
        c = text[at]
        if start and c == '"':
            inside, start, at = True, False, at + 1
            continue
        start = c == delimiter or c == "\r"
        at += 1
    return inside


def _transitions(delimiter: str):
    """Adds, for a part entered outside or inside quotes, the state after each line and the records ended so far."""

    def run(batches):
        part, state, ended, last = None, [False, True], [0, 0], [False, True]
        for batch in batches:
            names = batch.schema.names
            columns: list[list] = [[] for _ in range(6)]
            for own, text in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if own != part:
                    part, state, ended = own, [False, True], [0, 0]
                last = list(state)
                for entry in (0, 1):
                    if '"' in text:
                        state[entry] = ends_open(text, delimiter, state[entry])
                    for column, value in zip(columns[3 * entry : 3 * entry + 3], (last[entry], state[entry], ended[entry]), strict=True):
                        column.append(value)
                    ended[entry] += not state[entry]
            arrays = [pa.array(x, pa.int64() if i % 3 == 2 else pa.bool_()) for i, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, "in0", "out0", "rec0", "in1", "out1", "rec1"])

    return run


def quoted_start(line: Column, delimiter: str) -> Column:
    """Whether a quote stands where a field may start. No other quote means anything."""
    sign = "\\" + delimiter if delimiter in "\\]^-[" else delimiter
    return F.contains(line, F.lit('"')) & line.rlike(f'(?:^|[{sign}\r\n])"')


def any_open(lines: DataFrame, delimiter: str) -> bool:
    """Whether a line opens a quote that it leaves open; else no record spans lines. Only lines with a quote at a field's start go to Python."""

    @F.arrow_udf("boolean")
    def opens(texts: pa.Array) -> pa.Array:
        return pa.array([ends_open(t, delimiter, False) for t in texts.to_pylist()], pa.bool_())

    return not lines.filter(quoted_start(F.col("value"), delimiter)).filter(opens("value")).isEmpty()


def assemble(lines: DataFrame, delimiter: str) -> DataFrame:
    """Lines of one quoted record joined by line feeds; others pass through where they are."""
    return assembled(lines, delimiter) if any_open(lines, delimiter) else lines


def assembled(lines: DataFrame, delimiter: str) -> DataFrame:
    """The same where a line is known to leave a quote open. The parts' entry states follow from one small row for each part."""
    schema = T.StructType(list(lines.schema.fields))
    for entry in "01":
        schema = schema.add(f"in{entry}", "boolean").add(f"out{entry}", "boolean").add(f"rec{entry}", "long")
    stepped = lines.mapInArrow(_transitions(delimiter), schema)
    parts = stepped.groupBy("part").agg(F.max_by(F.struct("out0", "out1", "rec0", "rec1"), "pos").alias("e")).orderBy("part").collect()
    state, records, table = False, 0, []
    for r in parts:
        table.append((r["part"], state, records))
        e, entry = r["e"], int(state)
        state = (e["out0"], e["out1"])[entry]
        records += (e["rec0"], e["rec1"])[entry] + (not state)
    entries = by_part_size(lines.sparkSession.createDataFrame(table, "part long, entry boolean, before long"))
    joined = stepped.join(entries, "part")
    pick = lambda name: F.when(F.col("entry"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = joined.select(*lines.columns, pick("in").alias("inside"), pick("out").alias("open"), (F.col("before") + pick("rec")).alias("record"))
    single = placed.filter("not inside and not open").select(*lines.columns)
    counters = [c for c in lines.columns if c.startswith("n_")]
    several = placed.filter("inside or open").groupBy("record").agg(F.min(F.struct("pos", "part")).alias("first"), F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("all"), *(F.sum(c).cast("int").alias(c) for c in counters))
    several = several.select(F.col("first.part").alias("part"), F.col("first.pos").alias("pos"), F.array_join(F.transform("all", lambda x: x["value"]), "\n").alias("value"), *counters)
    # a record stays in the part of its first line, and parts stay whole
    merged = single.unionByName(several.select(*lines.columns))
    return merged.repartition("part").sortWithinPartitions("part", "pos").select(*lines.columns)


def split_quoted(text: str, delimiter: str) -> list[list[str]]:
    """Records of a text with quotes: carriage returns and line feeds outside quotes end a record, blank ones vanish."""
    records: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    inside, start, at, n = False, True, 0, len(text)

    def end_record() -> None:
        nonlocal row, cell
        if row or cell or not start:
            records.append([*row, "".join(cell)])
        row, cell = [], []

    while at < n:
        c = text[at]
        if inside:
            stop = text.find('"', at)
            stop = n if stop < 0 else stop
            cell.append(text[at:stop])
            if text.startswith('""', stop):
                cell.append('"')
                at = stop + 2
            else:
                inside, at = False, stop + 1
        elif start and c == '"':
            inside, start, at = True, False, at + 1
        elif c == delimiter:
            row.append("".join(cell))
            cell, start, at = [], True, at + 1
        elif c in "\r\n":
            end_record()
            start, at = True, at + 1
        else:
            cell.append(c)
            start, at = False, at + 1
    end_record()
    return records


def records(lines: DataFrame, options: Options) -> DataFrame:
    """(part, pos, cells, counters): one row for each record; a line with inner carriage returns may hold several."""
    delimiter = options.delimiter
    value = F.col("value")
    body = F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    inner = F.contains(body, F.lit("\r"))
    # quotes inside fields are text, so such lines are split as they are
    special = (quoted_start(value, delimiter) | F.contains(value, F.lit('"')) & F.contains(value, F.lit("\n")) | inner) if options.quoting else inner
    pattern = "[" + ("\\" + delimiter if delimiter in "\\]^-[" else delimiter) + "]"
    plain = F.when(body == "", F.array().cast("array<array<string>>")).otherwise(F.array(F.split(body, pattern, -1)))

    quoting = options.quoting

    @F.arrow_udf("array<array<string>>")
    def tokenize(texts: pa.Array) -> pa.Array:
        def one(text: str) -> list[list[str]]:
            if quoting:
                return split_quoted(text, delimiter)
            return [x.split(delimiter) for x in text.replace("\r", "\n").split("\n") if x]

        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    rows = lines.withColumn("_tok", tokenize(F.when(special, value)))
    rows = rows.withColumn("_all", F.when(special, F.col("_tok")).otherwise(plain))
    counters = [c for c in lines.columns if c.startswith("n_")]
    # the outer form, since the plain one infers a condition on the whole decoding and pushes it below every step
    out = rows.select("part", "pos", *counters, F.posexplode_outer("_all").alias("_sub", "cells")).filter("cells is not null")
    # a line's counters belong to its first record
    return out.select("part", "pos", F.col("_sub").alias("sub"), "cells", *(F.when(F.col("_sub") == 0, F.col(c)).otherwise(0).alias(c) for c in counters))


@dataclass
class Delimited:
    """An opened delimited file: names, the carrier of its rows, and their number of cells."""

    names: list[str]
    carrier: DataFrame

    @property
    def width(self) -> int:
        return len(self.names)


def open_delimited(spark: SparkSession, path: str, options: Options) -> Delimited:
    """Lines, quote repair, assembly, header, then trailing, join and realign repairs in this order."""
    lines = physical_lines(spark, path, options)
    if options.quoting and options.repair:
        lines = close_quotes(lines)
    else:
        lines = lines.withColumn("n_quote", F.lit(0))
    if options.quoting:
        lines = assemble(lines, options.delimiter)
    return _opened(records(lines, options), options)


def _opened(rows: DataFrame, options: Options, loose: DataFrame | None = None) -> Delimited:
    """loose: the same rows in any place, for what doesn't ask for their order."""
    # a record's place: its line's, then its place in the line
    both = [r.withColumn("pos", F.struct("pos", "sub")).drop("sub") for r in (rows, rows if loose is None else loose)]
    first = first_rows(both[1].select("pos", "cells"), 1).collect()
    if not first:
        raise ConversionError("CSV file has no rows")
    head = first[0]
    if options.no_headers:
        names = positional_names(len(head["cells"]))
    else:
        names = list(head["cells"])
        if options.trailing_delimiter and len(names) > 1 and names[-1] == "":
            names = names[:-1]
        both = [r.filter(F.col("pos") > place(head["pos"])) for r in both]
    width = len(names)
    if options.trailing_delimiter:
        both = [drop_trailing(r, width) for r in both]
    rows = both[0]
    if options.join_lines:
        rows = join_broken(rows, width, both[1])
    if options.realign:
        rows = realign(rows, width, options.delimiter)
    return Delimited(names, rows)


def from_text(lines: DataFrame, order: list[str], options: Options) -> Delimited:
    """The same for lines that a DataFrame holds in its column `value`."""
    lines = lines.withColumn("n_fallback", F.lit(0))
    lines = close_quotes(lines) if options.quoting and options.repair else lines.withColumn("n_quote", F.lit(0))
    own = ["part", "pos", "value", "n_fallback", "n_quote"]
    spans = options.quoting and any_open(lines, options.delimiter)
    if options.join_lines or options.realign or spans:
        loose, parts = by_ranges(lines, order)
        loose = loose.select(own)
        lines = dealt(loose, parts)
        if not spans:
            return _opened(records(lines, options), options, records(loose, options))
        lines = assembled(lines, options.delimiter)
    else:  # nothing looks from one line to the next, so the order's columns are place enough
        lines = lines.withColumn("part", F.lit(0).cast("long")).withColumn("pos", F.struct(*order)).select(own)
    return _opened(records(lines, options), options)
