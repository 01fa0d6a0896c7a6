"""Lines, quotes, records and row repairs; order must not depend on how input is dealt."""

import csv
import io
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabmend.config import JOIN_LOOKAHEAD, REALIGN_EXTRA
from tabmend.operators.carrier import boundaries, by_ranges, from_rows, rank_among
from tabmend.operators.repair import drop_trailing, join_broken, realign
from tabmend.options import ConversionError, Options
from tabmend.sources.lines import ends_open, from_text, open_delimited, physical_lines, split_quoted


def write(tmp_path, data, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def cells(opened):
    return [r["cells"] for r in opened.carrier.orderBy("pos").collect()]


def load(spark, tmp_path, data, **options):
    opened = open_delimited(spark, write(tmp_path, data), Options(**options))
    return opened.names, cells(opened)


def carrier(spark, rows, parts=1):
    """Rows dealt to parts in order, as a scan deals them."""
    at = [i * parts // max(1, len(rows)) for i in range(len(rows))]
    df = spark.createDataFrame([(p, i, r, 0) for i, (p, r) in enumerate(zip(at, rows, strict=True))], "part long, pos long, cells array<string>, n_quote int")
    return df.repartitionByRange(max(1, parts), "part").sortWithinPartitions("pos")


def test_plain_and_blank_lines(spark, tmp_path):
    assert load(spark, tmp_path, "k,town\n\n7,Ulm\r\n\r\n8,Bonn") == (["k", "town"], [["7", "Ulm"], ["8", "Bonn"]])


def test_lines_with_odd_quotes_are_closed(spark, tmp_path):
    data = 'k;note\n"7;up\n8;"down\n9;si"de\n10;"ev""en"\n'
    assert load(spark, tmp_path, data, delimiter=";")[1] == [["7;up"], ["8", "down"], ["9", 'si"de"'], ["10", 'ev"en']]


def test_an_even_line_may_still_open_a_quote(spark, tmp_path):
    # two quotes, of which the second opens a field that the next line ends
    rows = load(spark, tmp_path, 'k,note\nx"y,"first\nsecond","z\n')[1]
    assert rows[0][0] == 'x"y' and rows[0][1].startswith("first\nsecond")


def test_multi_line_records_without_repair(spark, tmp_path):
    data = 'a,b\n1,"x\ny ""q"" z\n\nw"\n2,v\n'
    assert load(spark, tmp_path, data, repair=False)[1] == [["1", 'x\ny "q" z\n\nw'], ["2", "v"]]


def test_no_quote_mode(spark, tmp_path):
    assert load(spark, tmp_path, 'a,b\n"x,y"\n', quoting=False)[1] == [['"x', 'y"']]


def test_no_headers_and_empty_file(spark, tmp_path):
    assert load(spark, tmp_path, "1,2\n3,4\n", no_headers=True) == (["c0", "c1"], [["1", "2"], ["3", "4"]])
    with pytest.raises(ConversionError, match="no rows"):
        load(spark, tmp_path, "")


def test_lone_carriage_returns_end_records(spark, tmp_path):
    assert load(spark, tmp_path, 'a,b\r1,2\r3,"4\r5"\r')[1] == [["1", "2"], ["3", "4\r5"]]


def test_fallback_lines(spark, tmp_path):
    lines = ["k;naïve".encode(), "1;Straße".encode("cp1252"), "2;日本".encode(), "3;plain".encode(), "4;café".encode("cp1252")]
    opened = open_delimited(spark, write(tmp_path, b"\n".join(lines)), Options(delimiter=";", encoding="utf-8", fallback_encoding="windows-1252"))
    assert opened.names == ["k", "naïve"]
    assert cells(opened) == [["1", "Straße"], ["2", "日本"], ["3", "plain"], ["4", "café"]]
    assert opened.carrier.agg({"n_fallback": "sum"}).first()[0] == 2


def test_single_and_double_byte_encodings(spark, tmp_path):
    assert load(spark, tmp_path, "имя,б\nЖук,я\n".encode("cp1251"), encoding="windows-1251")[1] == [["Жук", "я"]]
    assert load(spark, tmp_path, "a,б\n1,я\n".encode("utf-16")) == (["a", "б"], [["1", "я"]])


def test_trailing(spark, tmp_path):
    rows = [["p", "q", "r", ""], ["p", "q", "r", " "], ["p", "q", ""], ["p", "q", "r", "", ""]]
    got = drop_trailing(carrier(spark, rows), 3).orderBy("pos").collect()
    assert [r["cells"] for r in got] == [["p", "q", "r"], *rows[1:]]
    assert [r["n_trail"] for r in got] == [1, 0, 0, 0]
    assert load(spark, tmp_path, "k|town|\n7|Ulm|\n", delimiter="|", trailing_delimiter=True) == (["k", "town"], [["7", "Ulm"]])


def by_rule(rows, width):
    """Joins by the rule: a short row takes the next rows, LOOKAHEAD at most, if that makes it exactly as wide as the table."""
    out, joined, at = [], 0, 0
    while at < len(rows):
        size, took = len(rows[at]), 0
        while size < width and took < JOIN_LOOKAHEAD and at + took + 1 < len(rows):
            took += 1
            size += len(rows[at + took]) - 1
        if took and size == width and len(rows[at]) < width:
            row = list(rows[at])
            for more in rows[at + 1 : at + took + 1]:
                row = [*row[:-1], f"{row[-1]}\n{more[0]}", *more[1:]]
            out.append(row)
            joined, at = joined + took, at + took + 1
        else:
            out.append(rows[at])
            at += 1
    return out, joined


@pytest.mark.parametrize("seed", range(8))
def test_joins_follow_the_rule_for_any_parts(spark, seed):
    rng = random.Random(seed)
    width = rng.choice([2, 4, 5, 12])
    rows = []
    for i in range(80):
        full = [f"{i}.{j}" for j in range(width)]
        cut = rng.randrange(1, width)
        rows += rng.choice([[full], [full], [full[:cut], ["rest", *full[cut:]]], [full[:cut]], [["line"]] * rng.randrange(1, 11), [[*full, "more"]]])
    expected, joined = by_rule(rows, width)
    for parts in (1, 4, 13):
        got = join_broken(carrier(spark, rows, parts), width).orderBy("pos").collect()
        assert [r["cells"] for r in got] == expected
        assert sum(r["n_join"] for r in got) == joined


@pytest.mark.parametrize("seed", range(4))
def test_joins_of_a_table_over_many_parts_read_it_whole_once(spark, monkeypatch, seed):
    """Parts' edges are read apart from the rest, small batches and long runs of short rows included."""
    monkeypatch.setattr("tabmend.operators.carrier.LEAST_ROWS", 1)
    monkeypatch.setattr("tabmend.operators.repair.LONGEST_RUN", 10)
    rng = random.Random(seed)
    rows = [["k", "t", "n"]]
    for i in range(200):
        rows += rng.choice([[[f"{i}", "x", "y"]], [[f"{i}", "x"], ["more", "y"]], [[f"{i}"]], [["a", "b"]] * rng.randrange(1, 30), [[f"{i}", "x", "y", "z"]]])
    expected, joined = by_rule(rows[1:], 3)
    df = spark.createDataFrame([(i // 3, i % 3, ",".join(r)) for i, r in enumerate(rows)], "at long, line int, value string").repartition(3, "value")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        opened = from_text(df, ["at", "line"], Options(join_lines=True))
        # all rows, those at the edges, and their merge
        assert opened.carrier._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3
        got = opened.carrier.orderBy("pos").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [r["cells"] for r in got] == expected
    assert sum(r["n_join"] for r in got) == joined
    assert len({r["part"] for r in got}) > 5


def test_rows_are_dealt_by_their_number(spark):
    """A few rows make one task, however many the session has, and boundaries don't make the plan grow."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert from_rows(spark.range(3000).select(F.col("id").alias("at")), ["at"]).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert str(rank_among(F.col("at"), [F.lit(i) for i in range(100)])).count("WHEN") == 1


def test_ranges_are_in_order_and_equal_rows_lie_together(spark, monkeypatch):
    monkeypatch.setattr("tabmend.operators.carrier.PART_ROWS", 10)
    rng = random.Random(3)
    keys = [(rng.choice([None, *range(6)]), rng.choice([None, "", "a", "é", "zz"]), rng.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame([(*k,) for k in keys] * 2, "a int, b string, c int")
    small = lambda k: tuple((x is not None, x) for x in k)
    for order, rows in ((["a", "b", "c"], df), (["b", "a"], df), (["b"], df), (["a", "c"], df.filter("a is not null"))):
        ends = sorted({tuple(r) for r in boundaries(rows, order)}, key=small)
        assert len(ends) > 3
        for r in by_ranges(rows, order)[0].collect():
            assert r["part"] == sum(small(e) <= small([r[k] for k in order]) for e in ends)


def readings(row, width, kinds):
    """Ways to put a row's surplus cells back into one text column."""
    extra = len(row) - width
    for at in range(width):
        merged = [*row[:at], "|".join(row[at : at + extra + 1]), *row[at + extra + 1 :]]
        if kinds[at] == "text" and all(k == "text" or not c or re.fullmatch(r"-?[1-9][0-9]*|0" if k == "int" else r"-?[0-9]+(\.[0-9]+)?", c) for c, k in zip(merged, kinds, strict=True)):
            yield merged


@pytest.mark.parametrize("kinds", [["text", "int", "float"], ["int", "text", "text"], ["int", "text", "int", "text"], ["text"], ["int", "int"]])
def test_realign_takes_the_only_reading(spark, kinds):
    rng = random.Random(len(kinds))
    make = {"int": lambda: str(rng.randrange(1, 99)), "float": lambda: f"{rng.randrange(9)}.5", "text": lambda: rng.choice(["north", "Ulm", "x y"])}
    width = len(kinds)
    rows = [[make[k]() for k in kinds] for _ in range(20)]
    for _ in range(60):
        row = [make[k]() for k in kinds]
        at = rng.randrange(width)
        surplus = [rng.choice(["east", "3", "", "4.5"]) for _ in range(rng.randrange(1, 5))]
        rows.append([*row[: at + 1], *surplus, *row[at + 1 :]])
    got = realign(carrier(spark, rows, 3), width, "|").orderBy("pos").collect()
    for row, r in zip(rows, got, strict=True):
        found = list(readings(row, width, kinds)) if 1 <= len(row) - width <= REALIGN_EXTRA else []
        assert (r["cells"], r["n_realign"]) == ((found[0], 1) if len(found) == 1 else (row, 0))


TEXT = st.text(alphabet='ab,"\n', max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_split_equals_the_csv_module(text):
    expected = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    assert split_quoted(text, ",") == expected


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_assembly_by_lines_equals_the_whole(text):
    out, held, inside = [], [], False
    for line in text.split("\n"):
        held.append(line)
        inside = ends_open(line, ",", inside)
        if not inside:
            out += split_quoted("\n".join(held), ",")
            held = []
    out += split_quoted("\n".join(held), ",") if held else []
    assert out == split_quoted(text, ",")


def test_many_splits_keep_the_order(spark, tmp_path):
    rng = random.Random(5)
    lines = ["id,t"]
    for i in range(3000):
        lines.append(f'{i},"{"x" * rng.randrange(30)}\ny{i}"' if rng.random() < 0.1 else f"{i},{'z' * rng.randrange(60)}")
    path = write(tmp_path, "\n".join(lines) + "\n")
    expected = list(csv.reader(io.StringIO("\n".join(lines) + "\n")))[1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        opened = open_delimited(spark, path, Options(repair=False))
        assert cells(opened) == expected
        assert physical_lines(spark, path, Options()).select("part").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_of_a_table_keeps_records_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr("tabmend.operators.carrier.PART_ROWS", 100)
    rng = random.Random(9)
    lines = ["id,t"]
    for i in range(2000):
        lines += f'{i},"{"x" * rng.randrange(9)}\ny{i}\n\n"'.split("\n") if rng.random() < 0.3 else [f"{i},z"]
    expected = list(csv.reader(io.StringIO("\n".join(lines) + "\n")))[1:]
    df = spark.createDataFrame(list(enumerate(lines)), "at long, value string").repartition(7, "value")
    for options in (Options(repair=False), Options(repair=False, join_lines=True)):
        opened = from_text(df, ["at"], options)
        assert cells(opened) == expected
    assert opened.carrier.select("part").distinct().count() > 5


def test_several_files_of_two_byte_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        body = "".join(f'{i}{j},"wörd\n{j}"\n' for j in range(4))
        (tmp_path / "in" / f"{i}.csv").write_bytes((("k,w\n" if i == 0 else "") + body).encode("utf-16-le"))
    opened = open_delimited(spark, str(tmp_path / "in"), Options(encoding="utf-16le", repair=False))
    assert cells(opened) == [[f"{i}{j}", f"wörd\n{j}"] for i in range(3) for j in range(4)]


def test_quotes_inside_fields_need_no_tokenizer(spark, tmp_path):
    """Only a quote at a field's start sends a line to Python; the others are text."""
    from pyspark.sql import functions as F

    from tabmend.sources.lines import quoted_start

    lines = ['1,a"b"', '"1",b', '1,"b"', '1,b""', 'a\r"b', "plain"]
    got = spark.createDataFrame([(x,) for x in lines], "v string").select(quoted_start(F.col("v"), ",")).collect()
    assert [r[0] for r in got] == [False, True, True, False, True, False]
    assert load(spark, tmp_path, 'a,b\n1,x"y"\n2,z"\n3,"p"\n')[1] == [["1", 'x"y"'], ["2", 'z""'], ["3", "p"]]
