"""JSON, SQL dumps, SQLite, sheets and Parquet."""

import sqlite3
import zipfile

import pytest
from pyspark.errors import PySparkException

from tabmend.options import ConversionError, Options
from tabmend.plans.convert import open_source
from tabmend.sources import sheet, sqldump, sqlitedb
from tabmend.sources.columnar import rows_at


def opened(spark, path, kind, **options):
    source, table = open_source(spark, str(path), kind, Options(**options))
    return source.names, [r["cells"] for r in source.carrier.orderBy("pos").collect()], table


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return path


def test_json_array(spark, tmp_path):
    path = put(tmp_path, "a.json", '[{"z":1,"a":2.50},{"b":{"y":[1, 2],"x":null},"z":1e3},] junk')
    assert opened(spark, path, "json")[:2] == (["z", "a", "b"], [["1", "2.5", ""], ["1000.0", "", '{"y":[1,2],"x":null}']])


def test_json_streams(spark, tmp_path):
    lines = put(tmp_path, "a.jsonl", '{"a":"x\\ny","b":true}\n\n{"c":null,"a":"z"}\n')
    assert opened(spark, lines, "jsonl")[:2] == (["a", "b", "c"], [["x\ny", "true", ""], ["z", "", ""]])
    joined = put(tmp_path, "b.json", '{"a":1}{"a":\n2} {"b":[]}')
    assert opened(spark, joined, "json")[:2] == (["a", "b"], [["1", ""], ["2", ""], ["", "[]"]])


def test_json_errors(spark, tmp_path):
    with pytest.raises(ConversionError):
        opened(spark, put(tmp_path, "a.json", "  \n"), "json")
    with pytest.raises(PySparkException):
        opened(spark, put(tmp_path, "b.json", '{"a":1}\n3\n'), "json")
    for text in ('[,{"a":1}]', '[{"a":1} {"a":2}]', '[{"a":1}'):
        with pytest.raises((PySparkException, ConversionError)):
            opened(spark, put(tmp_path, "c.json", text), "json")


DUMP = r'''-- dump
/* a; b */ # more
CREATE TABLE IF NOT EXISTS `db`.`users` (
  `id` int NOT NULL, "full name" varchar(20) DEFAULT 'x,(y)', note text,
  PRIMARY KEY (`id`), KEY `k` (note), CONSTRAINT c CHECK (id > 0)
) ENGINE=InnoDB;
CREATE TABLE other (a int, b int);
INSERT INTO `users` VALUES (1,'O''Neil \'q\' \n',NULL),(2,"say ""hi""",NOW());
INSERT INTO other (b, a) VALUES (1, 2);
INSERT IGNORE INTO users VALUES (9,'no','no');
INSERT INTO db.users (note, id) VALUES (3, concat('a', 'b'), (1+2));
'''


def test_sql_dump(spark, tmp_path):
    path = put(tmp_path, "d.sql", DUMP)
    names, rows, table = opened(spark, path, "sql")
    assert (names, table) == (["id", "full name", "note"], "users")
    assert rows == [["1", "O'Neil 'q' \n", ""], ["2", 'say "hi"', "NOW ( )"], ["3", "b", "( 1+2 )"]]
    assert opened(spark, path, "dump", table="OTHER")[:2] == (["a", "b"], [["1", "2"]])
    with pytest.raises(ConversionError, match="users, other"):
        opened(spark, path, "sql", table="nope")


def test_sql_dump_without_create_or_rows(tmp_path):
    assert sqldump.schema(str(put(tmp_path, "a.sql", "INSERT INTO t (x, y) VALUES (1,2);"))) == ("t", ["x", "y"])
    assert sqldump.schema(str(put(tmp_path, "b.sql", "INSERT INTO t VALUES (1,2);"))) == ("t", ["c0", "c1"])
    only = str(put(tmp_path, "c.sql", "CREATE TABLE t (a int, b int);"))
    assert (sqldump.schema(only), list(sqldump.rows(only))) == (("t", ["a", "b"]), [])
    with pytest.raises(ConversionError):
        sqldump.schema(str(put(tmp_path, "d.sql", "SELECT 1;")))


def test_sqlite(spark, tmp_path):
    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE first ("a ""b" INT, t TEXT, f REAL)')
    db.executemany("INSERT INTO first VALUES (?, ?, ?)", [(i, None if i == 3 else f"t{i}", i / 2) for i in range(50)])
    db.execute("CREATE VIEW seen AS SELECT t FROM first WHERE f < 1")
    db.commit()
    db.close()
    names, rows, table = opened(spark, tmp_path / "x", "sqlite")
    assert (names, table, len(rows), rows[3]) == (['a "b', "t", "f"], "main", 50, ["3", "", "1.5"])
    assert opened(spark, path, "sqlite", table="seen")[1] == [["t0"], ["t1"]]
    with pytest.raises(ConversionError, match="first, seen"):
        sqlitedb.resolve(str(path), "nope")


def xlsx(path, rows, second="<row><c t='inlineStr'><is><t>no</t></is></c></row>"):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="R"><sheets><sheet name="s" r:id="r1"/><sheet name="t" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="worksheets/two.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>two</t></r><r><t> parts</t></r></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData>{second}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"/>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>7.0</v></c><c r="C3" s="1"><v>45292.5</v></c><c r="D3" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="B4"><v>2.5</v></c><c r="C4" t="e"><v>#DIV/0!</v></c></row>'
    )
    xlsx(tmp_path / "a.xlsx", rows)
    names, got, _ = opened(spark, tmp_path / "a.xlsx", "xlsx")
    assert names == ["name", "c1", "when", "c3"]
    assert got == [["two parts", "7", "2024-01-01 12:00:00", "true"], ["", "2.5", "#ERROR:#DIV/0!", ""]]
    assert len(opened(spark, tmp_path / "a.xlsx", "xlsx", no_headers=True)[1]) == 3


def test_ods(spark, tmp_path):
    cells = '<c:table-cell o:value-type="string"><p>a</p></c:table-cell><c:table-cell c:number-columns-repeated="2" o:value-type="float" o:value="3"><p>3.0</p></c:table-cell>'
    text = f'<d xmlns:c="C" xmlns:o="O"><c:table><c:table-row>{cells}</c:table-row><c:table-row c:number-rows-repeated="9000"><c:table-cell c:number-columns-repeated="16000"/></c:table-row><c:table-row>{cells}</c:table-row></c:table></d>'
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", text)
    assert opened(spark, tmp_path / "a.ods", "ods")[:2] == (["a", "3", "3"], [["a", "3", "3"]])
    with pytest.raises(ConversionError):
        sheet.header(str(put(tmp_path, "b.xlsx", "no zip")), False)


def test_parquet_text_and_rows(spark, tmp_path):
    df = spark.sql("SELECT id, cast(id AS double) * 1e10 AS d, timestamp '2024-01-02 03:04:05.5' AS t, array(1, 2) AS a, cast(null AS string) AS n FROM range(1, 4)").coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    names, rows, _ = opened(spark, tmp_path / "p", "parquet")
    assert (names, rows[0]) == (["id", "d", "t", "a", "n"], ["1", "10000000000.0", "2024-01-02T03:04:05.5", "[1,2]", ""])
    assert [r["id"] for r in rows_at(spark, str(tmp_path / "p"), [2, 0, 99]).orderBy("id").collect()] == [1, 3]


def test_dump_query_reads_back_every_order(spark, tmp_path):
    rows = [(i, "1-URGENT", 100.25 + i) for i in range(1, 201)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    from tabmend.queries import QUERIES

    out = QUERIES["sqldump_orders"](spark, str(tmp_path)).collect()
    assert sorted((int(r["k"]), r["p"], float(r["t"])) for r in out) == rows


@pytest.mark.parametrize("local", [True, False])
def test_folders_are_read_file_by_file(spark, tmp_path, monkeypatch, local):
    if not local:  # as if only Spark could read them
        monkeypatch.setattr("tabmend.sources.files.is_local", lambda path: "/copy" in path)
        monkeypatch.setattr("tabmend.sources.files.tempfile.mkdtemp", lambda prefix: str(tmp_path / "copy"))
        (tmp_path / "copy").mkdir()
    for kind in ("json", "sql", "ods"):
        (tmp_path / kind).mkdir()
    for i in range(3):
        (tmp_path / "json" / f"{i}.json").write_text("[" + ", ".join(f'{{"a": {i * 2000 + j}}}' for j in range(2000)) + "]")
        (tmp_path / "sql" / f"{i}.sql").write_text(f"INSERT INTO t (a, b) VALUES ({i}, 'x{i}'), ({i}, NULL);")
        cells = "".join(f"<table-row><table-cell><p>{x}</p></table-cell></table-row>" for x in ("head", f"r{i}", f"s{i}"))
        with zipfile.ZipFile(tmp_path / "ods" / f"{i}.ods", "w") as z:
            z.writestr("content.xml", f"<document><table>{cells}</table></document>")
    read = lambda kind: opened(spark, tmp_path / kind, kind)[1]
    assert read("json") == [[str(i)] for i in range(6000)]
    assert read("sql") == [[str(i), x] for i in range(3) for x in (f"x{i}", "")]
    assert read("ods") == [[f"{x}{i}"] for i in range(3) for x in "rs"]


ODD_VALUES = ['{"k":"a\\\\"}', '{"k":"}{[,\\"","m":[1,{"x":"é,"}]}', '{"n":{"x":[[],[1, 2]]}}', '{"k":-1.5e+3}', '{"k":"\\\\\\\\,\\"]"}', "{}"]


@pytest.mark.parametrize("shape", ["array", "stream"])
def test_parts_of_json_hold_every_value_once(spark, tmp_path, monkeypatch, shape):
    values = [ODD_VALUES[i * 7 % 6] for i in range(60)]
    text = "[" + " ,\n".join(values) + ',] x ["' if shape == "array" else "".join(v + ("\n" if i % 3 else " ") for i, v in enumerate(values)).replace('"k":', '"k":\n')
    path = put(tmp_path, "a.json", text)
    whole = opened(spark, path, "json")
    for size in (37, 64):
        monkeypatch.setattr("tabmend.sources.files.SPLIT", size)
        source = open_source(spark, str(path), "json", Options())[0]
        assert (source.names, [r["cells"] for r in source.carrier.orderBy("pos").collect()]) == whole[:2]
        assert source.carrier.select("part").distinct().count() > 5
    assert len(whole[1]) == 60


def test_parts_of_a_dump_start_at_statements(spark, tmp_path, monkeypatch):
    rows = [f"INSERT INTO t VALUES ({i}, 'it''s;\nINSERT INTO t VALUES (0, 0);\n'), ({i}, '\\';');\n/* ;\nINSERT INTO t VALUES (1, 1);\n */ -- '\n" for i in range(40)]
    path = put(tmp_path, "a.sql", "CREATE TABLE u (a int);\nCREATE TABLE t (a int, b text);\n" + "".join(rows))
    whole = opened(spark, path, "sql", table="t")
    monkeypatch.setattr("tabmend.sources.files.SPLIT", 300)
    assert opened(spark, path, "sql", table="t") == whole
    assert whole[1][:2] == [["0", "it's;\nINSERT INTO t VALUES (0, 0);\n"], ["0", "';"]] and len(whole[1]) == 80
    assert open_source(spark, str(path), "sql", Options(table="t"))[0].carrier.select("part").distinct().count() > 5
    with pytest.raises(PySparkException):
        from tabmend.sources.files import read_cells

        read_cells(spark, "sql", str(path), "w").collect()


def test_tokens_at_the_end_of_a_buffer(tmp_path, monkeypatch):
    """A doubled quote, or a number's exponent, of which only the start has been read."""
    from tabmend.sources import jsonsplit

    for chunk in range(1, 9):
        monkeypatch.setattr("tabmend.sources.sqldump.CHUNK", chunk)
        monkeypatch.setattr("tabmend.sources.jsonsplit.CHUNK", chunk)
        assert list(sqldump.rows(str(put(tmp_path, "a.sql", "INSERT INTO t VALUES ('a''b''', 'c');")))) == [["a'b'", "c"]]
        assert list(jsonsplit.values(str(put(tmp_path, "a.json", "[1.5e+3, 2.25]")))) == ["1.5e+3", "2.25"]


@pytest.mark.parametrize("name", ["json_array_orders", "sqldump_orders", "json_stream_events"])
def test_source_queries_write_and_read_side_by_side(spark, tmp_path, name):
    """Nothing comes to the driver row by row, and the parts of the table are read as parts."""
    import tabmend.more_queries  # noqa: F401
    from tabmend.queries import QUERIES

    spark.range(200).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "double(id) AS o_totalprice").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id AS event_id", "'a \"b\"' AS event_type").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES[name](spark, str(tmp_path))
    assert sorted(int(r[0]) for r in out.collect()) == list(range(200)) and out.rdd.getNumPartitions() > 1
