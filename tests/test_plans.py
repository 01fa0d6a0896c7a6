"""Sinks, conversions, doctor, search, command line and ingestion."""

import sqlite3

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabmend.cli import main
from tabmend.options import ConversionError, Options
from tabmend.plans.convert import convert
from tabmend.plans.doctor import Finding, Fix, Report, apply_safe, examine_bytes, suggested_command
from tabmend.search import lookup_all, postings, search_all
from tabmend.sinks.files import codec_level, recode_exact
from tabmend.sinks.paths import output_path
from tabmend.sinks.sqlitedb import batch_rows, load
from tabmend.streaming.ingest import ingest_available

DIRTY = 'stop,wait,open,zone\n12,0.75,FALSE,0B\n13,4,,\n-1,,True,x\nlast,1e-2,shut,\n'


def source(tmp_path, text=DIRTY):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_typed_sqlite(spark, tmp_path):
    out = convert(spark, source(tmp_path), str(tmp_path / "o"), "csv", "sqlite", Options(sqlite_mode="typed", infer_rows=3, table="stops"))
    db = sqlite3.connect(out.path)
    assert db.execute("SELECT * FROM stops").fetchall() == [(12, 0.75, 0, "0B"), (13, 4.0, None, ""), (-1, None, 1, "x"), (None, 0.01, None, "")]
    assert [r[1:3] for r in db.execute("PRAGMA table_info(stops)")] == [("stop", "INTEGER"), ("wait", "REAL"), ("open", "INTEGER"), ("zone", "TEXT")]
    assert (out.metrics.mismatches, out.metrics.exit_code) == (2, 2)
    assert not any("last" in m or "shut" in m for m in out.messages)
    with pytest.raises(sqlite3.IntegrityError):
        db.execute("INSERT INTO stops VALUES (1, 'far', 0, '')")


def test_strict_misfit_names_row_and_column_only(spark, tmp_path):
    text = "town,size\n" + "".join(f"t{i},{i * 10}\n" for i in range(6)) + "u,hidden\n"
    with pytest.raises(ConversionError, match="row 7.*'size'") as error:
        convert(spark, source(tmp_path, text), str(tmp_path / "o"), "csv", "parquet", Options(infer_types=True, infer_rows=4, strict=True))
    assert "hidden" not in str(error.value)


def test_full_text_sqlite(spark, tmp_path):
    text = "title,body\nHarbour,ships at anchor\nMill,\nHarbour mill,wheels\n"
    convert(spark, source(tmp_path, text), str(tmp_path / "o"), "csv", "sqlite", Options(table="places"))
    db = sqlite3.connect(tmp_path / "o.db")
    find = lambda q: [r[0] for r in db.execute("SELECT title FROM places WHERE places MATCH ? ORDER BY rowid", (q,))]
    assert find("mill") == ["Mill", "Harbour mill"] and find("body:ships") == ["Harbour"] and find("anchor wheels") == []


def test_bulk_load_restores_settings_and_replaces_whole_files(tmp_path):
    path = str(tmp_path / "x.db")
    rows = [(f"entry {i}", "even" if i % 2 == 0 else "odd") for i in range(2345)]
    assert load(path, "big list", ["a", "b"], None, rows, batch=100) == 2345
    count = lambda where="": sqlite3.connect(path).execute(f'SELECT count(*) FROM "big list" {where}').fetchone()[0]
    assert count("WHERE \"big list\" MATCH 'even'") == 1173
    assert dict(sqlite3.connect(path).execute('SELECT k, v FROM "big list_config"'))["automerge"] == 4
    load(path, "BIG list", ["a", "b"], None, [("more", "odd")])
    assert count() == 2346
    with pytest.raises(sqlite3.Error):
        load(path, "big list", ["a", "b"], None, [("one", "two", "three")])
    assert count() == 2346
    names = [f"n{i}" for i in range(411)]
    load(path, "broad", names, ["int"] * 411, [tuple(range(i, i + 411)) for i in range(150)])
    assert sqlite3.connect(path).execute("SELECT count(*), sum(n410) FROM broad").fetchone() == (150, sum(range(410, 560)))
    assert [batch_rows(n, 50_000) for n in (1, 411, 32_766)] == [32_766, 79, 1]


def test_csv_and_parquet_round_trip(spark, tmp_path):
    out = convert(spark, source(tmp_path, 'a,b\n"x,""y""",1\n,2\n'), str(tmp_path / "o"), "csv", "csv", Options(single_file=True))
    assert open(out.path).read() == 'a,b\n"x,""y""",1\n,2\n'
    out = convert(spark, out.path, str(tmp_path / "p"), "csv", "parquet", Options(infer_types=True))
    assert [tuple(r) for r in spark.read.parquet(out.path).orderBy("b").collect()] == [('x,"y"', 1), ("", 2)]
    for codec in ("brotli", "lz4", "gzip", "snappy", "none"):
        out = convert(spark, source(tmp_path), str(tmp_path / codec), "csv", "parquet", Options(codec=codec))
        assert len(pq.read_table(out.path)) == 4


def test_codecs_and_paths():
    assert [codec_level(c, None)[1] for c in ("zstd", "gzip", "brotli", "snappy")] == [3, 6, 5, None]
    for codec, level in (("zstd", 23), ("gzip", 10), ("nope", None)):
        with pytest.raises(ConversionError):
            codec_level(codec, level)
    assert [output_path("x", "csv"), output_path("x.csv", "csv"), output_path("x.db", "sqlite")] == ["x.csv", "x.csv", "x.db.db"]


def typed_table():
    """Nulls, nested values and a decimal in row groups of uneven size."""
    import decimal

    n = 11
    return pa.table({
        "price": pa.array([None if i % 4 == 1 else decimal.Decimal(i) / 8 for i in range(n)], pa.decimal128(9, 3)),
        "day": pa.array([None if i == 3 else i * 400 for i in range(n)], pa.date32()),
        "path": pa.array([None if i % 5 == 2 else [None, f"p{i}"][: i % 3] for i in range(n)], pa.list_(pa.string())),
        "at": pa.array([None if i == 7 else {"x": i, "y": None if i % 2 else i / 2} for i in range(n)], pa.struct([("x", pa.int32()), ("y", pa.float64())])),
    }).replace_schema_metadata({"maker": "a test", "season": "autumn"})


def test_exact_recode(spark, tmp_path):
    table, src, dst = typed_table(), str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    pq.write_table(table, src, row_group_size=4, compression="gzip")
    assert recode_exact(spark, src, dst, Options(codec="snappy")) == 11
    for path in (dst, convert(spark, src, str(tmp_path / "c"), "parquet", "parquet", Options(codec="snappy")).path):
        file = pq.ParquetFile(path)
        assert [file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)] == [4, 4, 3]
        assert file.metadata.row_group(2).column(1).compression == "SNAPPY"
        assert {k: file.schema_arrow.metadata[k] for k in (b"maker", b"season")} == {b"maker": b"a test", b"season": b"autumn"}
        assert file.read().equals(table)
    out = convert(spark, src, str(tmp_path / "d"), "parquet", "parquet", Options(columns="one,two,three,four"))
    assert spark.read.parquet(out.path).columns == ["one", "two", "three", "four"]
    with pytest.raises(ConversionError):
        convert(spark, src, str(tmp_path / "e"), "parquet", "parquet", Options(columns="one,two"))
    assert not (tmp_path / "e.parquet").exists()
    pq.write_table(table.slice(0, 0), src)
    assert pq.read_table(convert(spark, src, str(tmp_path / "f"), "parquet", "parquet", Options()).path).schema.equals(table.schema)


def test_a_folder_is_recoded_by_its_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice").repartition(4).write.parquet(str(tmp_path / "in"))
    out = convert(spark, str(tmp_path / "in"), str(tmp_path / "o"), "parquet", "parquet", Options(codec="gzip"))
    assert (out.metrics.rows, spark.read.parquet(out.path).count()) == (100, 100)


def test_count_of_a_database(spark, tmp_path, capsys):
    path = str(tmp_path / "n.db")
    load(path, "main", ["k"], ["int"], [(i,) for i in range(321)])
    assert main(["-i", path, "-f", "sqlite", "-t", "csv", "-o", str(tmp_path / "o"), "--count", "-y"], spark) == 0
    assert "321 rows in table main" in capsys.readouterr().out


def test_nothing_is_touched_without_consent(spark, tmp_path):
    for target in ("csv", "parquet", "sqlite"):
        assert convert(spark, source(tmp_path), str(tmp_path / "o"), "csv", target, Options(), confirm=lambda _: False) is None
    assert [p.name for p in tmp_path.iterdir()] == ["in.csv"]
    with pytest.raises(ConversionError, match="same"):
        convert(spark, source(tmp_path), str(tmp_path / "in"), "csv", "csv", Options())
    for kinds in (("sqlite", "sqlite"), ("csv", "mysql"), ("doc", "csv")):
        with pytest.raises(ConversionError):
            convert(spark, source(tmp_path), str(tmp_path / "o"), *kinds, Options())


def found(spark, data, **options):
    report = examine_bytes(spark, data if isinstance(data, bytes) else data.encode(), Options(**options))
    return {f.fix.option: (f.level, f.fix.value) for f in report.findings if f.fix}, report


def test_doctor_layouts(spark):
    assert found(spark, "a;b\n1;x\n2;y\n")[0]["delimiter"] == ("safe", ";")
    assert "delimiter" not in found(spark, "a,b\n1,x\n")[0]
    assert found(spark, "a,b\n1,x,\n2,y,\n")[0]["trailing_delimiter"] == ("safe", True)
    assert found(spark, "a,b,c\n1,x,y\n2,z\n")[0]["join_lines"] == ("suggestion", True)
    assert found(spark, "1,x\n2,y\n")[0]["no_headers"][0] == "suggestion"
    assert "no_headers" not in found(spark, "id,n\n2,y\n3,z\n")[0]
    assert found(spark, "id,n,v\n1,a,2\n2,b,3\n3,c, d,4\n")[0]["realign"] == ("suggestion", True)
    assert found(spark, "a|b\n1|CafÃ©\n")[0]["fix_mojibake"] == ("suggestion", "windows-1252")
    assert found(spark, "plain\nword\n")[1].findings[-1].message == "no records were found"


def test_doctor_encodings(spark):
    french = "nom,ville\nRené,Besançon\nÉlodie,Orléans\n".encode("cp1252")
    assert found(spark, french, encoding="utf-8")[0]["fallback_encoding"] == ("suggestion", "windows-1252")
    assert found(spark, "a,b\n1,é\n", encoding="windows-1252")[0]["encoding"] == ("safe", "utf-8")


def test_safe_fixes_respect_the_caller():
    report = Report([Finding("safe", "", Fix("delimiter", ";")), Finding("safe", "", Fix("join_lines", True)), Finding("suggestion", "", Fix("realign", True))])
    options, rest = apply_safe(Options(), report)
    assert (options.delimiter, options.join_lines, rest) == (";", True, [Fix("realign", True)])
    options, rest = apply_safe(Options(explicit={"delimiter"}), report)
    assert (options.delimiter, options.join_lines) == (",", True)
    assert Fix("delimiter", ";") in rest
    assert suggested_command(["x", "--doctor", "-i", "a b"], [Fix("delimiter", "\t"), Fix("realign", True)]) == "x -i 'a b' -d '\\t' --realign"


def test_search(spark):
    df = spark.createDataFrame([(1, "Élan vital"), (2, "elan, only"), (3, None)], "id int, t string")
    assert [r.id for r in search_all(df, ["t"], ["ELAN", "vital"]).collect()] == [1]
    index = postings(df, "id", ["t"])
    assert sorted(r.id for r in lookup_all(index, "id", ["élan"]).collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    path = source(tmp_path, "a;b\n1;x\n2;y;z\n")
    assert main(["-i", path, "-o", str(tmp_path / "o"), "-t", "parquet", "-y"], spark) == 2
    assert spark.read.parquet(str(tmp_path / "o.parquet")).columns == ["a", "b"]
    assert main(["-i", path, "--doctor", "--log-level", "ERROR"], spark) == 0
    with pytest.raises(SystemExit):
        main(["-i", path, "--log-level", "LOUD"], spark)
    assert main(["-i", path, "-o", str(tmp_path / "n"), "-t", "csv"], spark, ask=lambda _: "n") == 0
    assert main(["-i", path, "-t", "nope"], spark) == 1
    capsys.readouterr()


def test_ingestion_runs_once_for_each_file(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.csv").write_text(f'id,t\n{i},"x\nbad,y\n')
        ingest_available(spark, folder, out, state, ["id", "t"], ["int", "text"], Options())
    rows = sorted((r.id, r.t) for r in spark.read.parquet(out).collect() if r.id is not None)
    assert rows == [(0, "x"), (1, "x")]
    assert spark.read.parquet(out).count() == 4
