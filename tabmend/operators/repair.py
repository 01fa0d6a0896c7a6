"""Row repairs: trailing empty cells, lines broken inside a field, cells shifted by stray delimiters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabmend.config import JOIN_LOOKAHEAD, REALIGN_EXTRA, REALIGN_PROFILE
from tabmend.functions.typed import TEXT, fits
from tabmend.operators.carrier import by_part_size, first_rows
from tabmend.operators.infer import infer_types


def drop_trailing(carrier: DataFrame, width: int) -> DataFrame:
    """Rows one cell too wide whose last cell is empty lose it; n_trail counts them."""
    odd = (F.size("cells") == width + 1) & (F.element_at("cells", -1) == "")
    return carrier.withColumn("n_trail", odd.cast("int")).withColumn("cells", F.when(odd, F.slice("cells", 1, width)).otherwise(F.col("cells")))


def greedy_joins(widths: list[int], width: int) -> list[int]:
    """For each head row of a run, how many following rows it takes in; rows taken in have no entry of their own.

    A row of some but too few cells takes in following rows, JOIN_LOOKAHEAD at most,
    while it stays too short; a join that does not end at exactly `width` is undone.
    Joining cells over a line break, k rows have the sum of their cells less k - 1.
    """
    out, at = [], 0
    while at < len(widths):
        total, took = widths[at], 0
        if 0 < total < width:
            while took < JOIN_LOOKAHEAD and total < width and at + took + 1 < len(widths):
                took += 1
                total += widths[at + took] - 1
        if total != width:
            took = 0
        out.append(took)
        at += took + 1
    return out


def join_rows(rows: list[list[str]]) -> list[str]:
    out = list(rows[0])
    for row in rows[1:]:
        out[-1:] = [out[-1] + "\n" + (row[0] if row else ""), *row[1:]]
    return out


def _joined_in_parts(width: int, names: list[str]):
    """Joins within a part; rows that hang on the parts around are marked `edge`.

    A row after one that is not short always heads a run, so a part is on its own
    from its first such row, and up to the short rows at its end. Only rows that are
    joined become Python's; all others leave as the Arrow values that they came as.
    """
    cells, part_at = names.index("cells"), names.index("part")
    summed = [i for i, n in enumerate(names) if n.startswith("n_")]

    def joins(widths: list[int], first: int, heads: list[int], tooks: list[int]) -> None:
        """The joins of one run that starts at row `first`."""
        at = first
        for took in greedy_joins(widths, width):
            if took:
                heads.append(at)
                tooks.append(took)
            at += took + 1

    def made(columns: list[pa.Array], heads: list[int], tooks: list[int], edge, stop: int, schema: pa.Schema) -> pa.RecordBatch:
        """The rows before `stop`, with the joined ones in their heads' places."""
        gone, n_join, index = np.zeros(stop, bool), np.zeros(stop, np.int32), np.arange(stop)
        if heads:
            at, took = np.array(heads), np.array(tooks)
            n_join[at] = took
            index[at] = len(columns[cells]) + np.arange(len(at))
            members = np.repeat(at, took + 1) + np.arange(int((took + 1).sum())) - np.repeat(np.cumsum(took + 1) - took - 1, took + 1)
            gone[members] = True
            gone[at] = False
            lists, joined, start = columns[cells].take(pa.array(members)).to_pylist(), [], 0
            for n in tooks:
                joined.append(join_rows(lists[start : start + n + 1]))
                start += n + 1
            own = {cells: joined}
            for i in summed:
                sums = np.concatenate([[0], np.cumsum(columns[i].fill_null(0).to_numpy(zero_copy_only=False))])
                own[i] = sums[at + took + 1] - sums[at]
            columns = [pa.concat_arrays([c, pa.array(own[i], c.type)]) if i in own else c for i, c in enumerate(columns)]
        else:
            own = {}
        keep = np.flatnonzero(~gone)
        if len(keep) == len(columns[part_at]) and not own:
            out = columns
        else:
            out = [c.take(pa.array(index[keep] if i in own else keep)) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*out, pa.array(n_join[keep]), pa.array(edge[keep])], schema=schema)

    def run(batches):
        schema, held, part, settled = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([*batch.schema, pa.field("n_join", pa.int32()), pa.field("edge", pa.bool_())])
            columns = batch.columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns, strict=True)]
            parts = columns[part_at].to_numpy(zero_copy_only=False)
            widths = columns[cells].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            short, size = (widths > 0) & (widths < width), len(parts)
            edge, heads, tooks, stop = np.zeros(size, bool), [], [], size
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), size]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if parts[start] != part:
                    part, settled = parts[start], False
                full = np.flatnonzero(~short[start:end]) + start
                if not settled:
                    first = int(full[0]) + 1 if len(full) else end
                    edge[start:first] = True
                    settled, start = len(full) > 0, first
                last = int(full[-1]) + 1 if len(full) else start  # short rows from here on have no end in sight
                inside = np.flatnonzero(short[start:last]) + start
                if len(inside):
                    breaks = np.flatnonzero(np.diff(inside) > 1)
                    for a, b in zip(inside[np.concatenate([[0], breaks + 1])].tolist(), inside[np.append(breaks, len(inside) - 1)].tolist(), strict=True):
                        joins(widths[a : b + 2].tolist(), a, heads, tooks)
                while settled and end - last >= LONGEST_RUN:  # of a long run of short rows, all but the last are decided, by its rows alone
                    tail = widths[last : last + LONGEST_RUN].tolist()
                    cut = _decided(tail, width)
                    joins(tail[:cut], last, heads, tooks)
                    last += cut
                if end < size:
                    edge[last:end] = True
                elif settled:
                    stop = last
            if stop:
                yield made([c.slice(0, stop) for c in columns], heads, tooks, edge[:stop], stop, schema)
            held = [c.slice(stop) for c in columns] if stop < size else None
        if held is not None:
            yield made(held, [], [], np.ones(len(held[0]), bool), len(held[0]), schema)

    return run


#: Rows of a run of short rows that are held before the decided ones leave.
LONGEST_RUN = 4096


def _decided(widths: list[int], width: int) -> int:
    """How many first rows of a run belong to joins whose head has all its JOIN_LOOKAHEAD rows in sight."""
    at = 0
    for took in greedy_joins(widths, width):
        if at + JOIN_LOOKAHEAD >= len(widths):
            break
        at += took + 1
    return at


def join_broken(carrier: DataFrame, width: int, loose: DataFrame | None = None) -> DataFrame:
    """Records that line breaks cut are put together again; n_join counts rows that were taken in.

    Only rows at the edges of parts, between the last full row of one part and the
    first of a later one, are shuffled. They are found by each part's first and last full
    row, for which `loose`, the carrier's rows in any place, is enough.
    """
    names = carrier.columns
    loose = carrier if loose is None else loose.select(names)
    schema = T.StructType(list(carrier.schema.fields)).add("n_join", "integer").add("edge", "boolean")
    joined = _joined_in_parts(width, names)
    inside = carrier.mapInArrow(joined, schema)
    # an edge row's run: the number of parts' heads (first full row seen) before it
    full = ~((F.size("cells") > 0) & (F.size("cells") < width))
    at = F.when(full, F.col("pos"))
    ends = loose.groupBy("part").agg(F.min(at).alias("head"), F.max(at).alias("last")).orderBy("part").collect()
    before, rows = 0, []
    for r in ends:
        rows.append((r["part"], before, r["head"], r["last"]))
        before += r["head"] is not None
    if not rows:
        return inside.drop("edge")
    place = carrier.schema["pos"].dataType
    starts = by_part_size(carrier.sparkSession.createDataFrame(rows, T.StructType().add("part", "long").add("before", "long").add("head", place).add("last", place)))
    near = loose.join(starts, "part").filter(F.col("head").isNull() | (F.col("pos") <= F.col("head")) | (F.col("pos") >= F.col("last")))
    near = near.select(names).repartition("part").sortWithinPartitions("part", "pos")
    edges = near.mapInArrow(joined, schema).filter("edge")
    placed = edges.join(starts, "part").withColumn("run", F.col("before") + F.coalesce((F.col("pos") > F.col("head")).cast("int"), F.lit(0)))
    row = F.struct("pos", *(c for c in names if c != "pos"))
    runs = placed.groupBy("run").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def merge(batches):
        cells = "cells"
        for batch in batches:
            out = []
            for group in batch.column("rows").to_pylist():
                at = 0
                for took in greedy_joins([len(r[cells]) for r in group], width):
                    part = group[at : at + took + 1]
                    first = dict(part[0])
                    if took:
                        first[cells] = join_rows([r[cells] for r in part])
                        for n in names:
                            if n.startswith("n_"):
                                first[n] = sum(r[n] for r in part)
                    out.append(first | {"n_join": took})
                    at += took + 1
            if out:
                kind = batch.schema.field("rows").type.value_type
                fields = {f.name: f.type for f in kind}
                yield pa.RecordBatch.from_pylist(out, pa.schema([*(pa.field(n, fields[n]) for n in names), pa.field("n_join", pa.int32())]))

    merged = runs.select("rows").mapInArrow(merge, T.StructType(list(carrier.schema.fields)).add("n_join", "integer"))
    return inside.filter("not edge").drop("edge").unionByName(merged)


def realign(carrier: DataFrame, width: int, delimiter: str) -> DataFrame:
    """Rows with one to REALIGN_EXTRA cells too many whose surplus belongs to one text column, if exactly one such reading fits all types.

    Types come from the first REALIGN_PROFILE rows of the right width; the repair is
    one expression for each row.
    """
    clean = first_rows(carrier.filter(F.size("cells") == width), REALIGN_PROFILE)
    kinds = infer_types(clean, [F.get("cells", F.lit(i)) for i in range(width)])
    texts = [i for i, k in enumerate(kinds) if k == TEXT]
    extra = F.size("cells") - width
    able = (extra >= 1) & (extra <= REALIGN_EXTRA)
    if not texts:
        return carrier.withColumn("n_realign", F.lit(0))

    def reading(at: int):
        middle = F.array_join(F.slice("cells", F.lit(at + 1), extra + 1), delimiter)
        return F.concat(F.slice("cells", F.lit(1), F.lit(at)), F.array(middle), F.slice("cells", extra + at + 2, F.lit(width - at - 1)))

    readings = []
    for at in texts:
        # cells before the merged one keep their place, those after it move by the surplus
        fit = F.lit(True)
        for i, kind in enumerate(kinds):
            if kind != TEXT:
                fit = fit & fits(F.get("cells", F.lit(i) if i < at else F.lit(i) + extra), kind)
        readings.append(F.when(fit, F.lit(at)))
    found = F.array_compact(F.array(*readings))
    rows = carrier.withColumn("_found", F.when(able, found))
    one = F.coalesce(F.size("_found") == 1, F.lit(False))
    fixed = F.coalesce(*(F.when(F.get("_found", F.lit(0)) == at, reading(at)) for at in texts), F.col("cells"))
    return rows.withColumn("n_realign", one.cast("int")).withColumn("cells", F.when(one, fixed).otherwise(F.col("cells"))).drop("_found")
