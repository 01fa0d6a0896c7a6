"""Further queries: sources written for the purpose and read back, guard messages, whole conversions."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.functions import charset
from tabmend.functions.typed import FLOAT, INT, TEXT
from tabmend.operators.guard import guard, kept, warnings
from tabmend.operators.infer import require_fit
from tabmend.operators.names import output_names, quoted
from tabmend.options import ConversionError, Options
from tabmend.plans.convert import convert, open_source, source_format
from tabmend.plans.doctor import examine_bytes
from tabmend.queries import cell, cells_of, folder, odd_widths, query, table, text_lines, typed, write_pieces
from tabmend.sinks import files as file_sinks
from tabmend.sinks.paths import output_path
from tabmend.sources import sqldump
from tabmend.sources.lines import from_text, open_delimited


def refused(run, *args) -> str:
    """The message with which something is refused; nothing where it isn't."""
    try:
        run(*args)
    except ConversionError as error:
        return str(error)
    return ""


def put(spark: SparkSession, name: str, pieces: Iterable[str], encoding: str = "utf-8") -> str:
    """The path of a new file of these pieces."""
    path = folder(spark) / name
    with path.open("w", encoding=encoding, newline="") as f:
        for piece in pieces:
            f.write(piece)
    return str(path)


def named(opened) -> DataFrame:
    return opened.carrier.select(*(cell(i).alias(n) for i, n in enumerate(opened.names)))


# Guard and types

ODD = "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 97 = 2"


@query(f"WITH b AS (SELECT min(k) AS k FROM ({ODD})) SELECT 'row ' || (SELECT count(*) FROM orders, b WHERE o_orderkey <= k) || ': got ' || CASE WHEN k % 5 = 0 THEN 2 WHEN k % 5 = 1 THEN 5 ELSE 4097 END || ' fields, expected 3' AS message FROM b")
def strict_width_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(refused(guard, odd_widths(spark, sf_dir), 3, Options(strict=True)),)], "message string")


@query(
    f"WITH b AS ({ODD}) SELECT message FROM (SELECT 'row at ' || k || ': ' || CASE WHEN k % 5 NOT IN (0, 1) THEN 'dropped' ELSE 'made 3 fields wide' END AS message FROM b ORDER BY k LIMIT 10) "
    "UNION ALL SELECT (count(*) - 10) || ' more rows' FROM b"
)
def guard_warnings_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in warnings(guard(odd_widths(spark, sf_dir), 3, Options()), 3)], "message string")


@query("SELECT doc_id, left(trim(text, 'AEIOTaeiot. '), 17) AS text FROM documents")
def guard_steps_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = charset.decode_single_byte(F.encode("text", "UTF-8"), "windows-1252")
    carrier = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.array(wrong).alias("cells"))
    clean = kept(guard(carrier, 1, Options(fix_mojibake="windows-1252", trim="AEIOTaeiot. ", max_field=17)))
    return clean.select(F.col("pos").alias("doc_id"), cell(0).alias("text"))


@query("SELECT 'row ' || (SELECT count(*) FROM orders o WHERE o.o_orderkey <= k) || ': column ''v'' is not int' AS message FROM (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey % 7 = 3)")
def strict_misfit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderkey") % 7 == 3, "many").otherwise(F.col("o_orderkey").cast("string"))
    carrier = cells_of(orders, "o_orderkey", [F.col("o_orderstatus"), v])
    return spark.createDataFrame([(refused(require_fit, carrier, ["s", "v"], [TEXT, INT]),)], "message string")


@query("SELECT * FROM (VALUES ('a,b,a', 'p, q ,p', 'p|q|p_1'), ('a,b', 'p', '1 column names for 2 columns'), ('a,b', 'p,', 'a column name is empty'), ('a\"b', NULL, '\"a\"\"b\"')) t(source, given, result)")
def output_names_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for source, given in (("a,b,a", "p, q ,p"), ("a,b", "p"), ("a,b", "p,"), ('a"b', None)):
        names = source.split(",")
        failed = refused(output_names, names, given)
        rows.append((source, given, failed or (quoted(output_names(names, given)[0]) if given is None else "|".join(output_names(names, given)))))
    return spark.createDataFrame(rows, "source string, given string, result string")


# Repairs together

@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name || chr(10) || 'more' WHEN s_suppkey % 5 = 0 THEN replace(s_name, '#', ';') ELSE s_name END AS s_name, s_acctbal FROM supplier")
def repairs_together_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing delimiters, broken rows and names with the delimiter in one file."""
    k, name, balance = (F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_acctbal"))
    whole = F.array(F.concat_ws(";", k, name, balance, F.lit("")))
    split = F.array(F.concat_ws(";", k, F.replace(name, F.lit("#"), F.lit(";")), balance))
    broken = F.array(F.concat_ws(";", k, name), F.concat_ws(";", F.lit("more"), balance))
    lines = F.when(F.col("s_suppkey") % 7 == 0, broken).when(F.col("s_suppkey") % 5 == 0, split).otherwise(whole)
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("at"), F.posexplode(lines).alias("line", "value"))
    lines = lines.unionByName(spark.createDataFrame([(-1, 0, "s_suppkey;s_name;s_acctbal;")], "at long, line int, value string"))
    options = Options(delimiter=";", trailing_delimiter=True, join_lines=True, realign=True)
    return typed(from_text(lines, ["at", "line"], options), [INT, TEXT, FLOAT])


# Sources

@query("SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p, '{\"x\":[1,2]}' AS n, '' AS z FROM orders")
def json_array_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array for each part of the table, in a folder."""
    row = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.struct(F.array(F.lit(1), F.lit(2)).alias("x")).alias("n"), F.lit(None).cast("string").alias("z"))
    objects = table(spark, sf_dir, "orders").select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
    path = write_pieces(objects, str(folder(spark) / "o"), "[", ",\n", "]", ",")
    return named(open_source(spark, path, "json", Options())[0])


@query("SELECT event_id::VARCHAR AS id, event_type AS t FROM events")
def json_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values on a line, and values over two lines; a file for each part of the table."""
    n = F.monotonically_increasing_id()
    name = F.regexp_extract(F.to_json(F.struct(F.col("event_type").alias("t")), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
    value = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(","), F.when(n % 3 == 0, "\n").otherwise(" "), name, F.when(n % 2 == 0, "}").otherwise("}\n"))
    path = str(folder(spark) / "e")
    table(spark, sf_dir, "events").select(value.alias("value")).write.option("lineSep", " ").text(path)
    return named(open_source(spark, path, "ndjson", Options())[0])


@query("SELECT n_nationkey::VARCHAR AS k, n_name || '''s' || chr(10) || 'end' AS name, CASE WHEN n_regionkey = 0 THEN '' ELSE n_regionkey::VARCHAR END AS r FROM nation")
def sqldump_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, qualified and quoted names, constraints, both ways to escape, NULL, and statements of another table between."""
    head = "-- a dump; of two tables\n/* INSERT INTO nation VALUES (1); */\n# more\nCREATE TABLE IF NOT EXISTS db.other (a int);\n"
    head += "CREATE TABLE `db`.`nation` (`k` int NOT NULL, name varchar(25) DEFAULT 'x,(y', r int, PRIMARY KEY (`k`), KEY i (name));\nINSERT INTO other VALUES (1), (2);\n"
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows
    text = lambda i, n: n + ("\\'s\\nend" if i % 2 else "''s\nend")
    body = [f"INSERT INTO `db`.`nation` (`k`, `name`, `r`) VALUES ({r[0]}, '{text(r[0], r[1])}', {r[2] or 'NULL'});\nINSERT INTO other VALUES (NOW(), ({r[0]}));\n" for r in rows]
    return named(open_source(spark, put(spark, "d.sql", [head, *body]), "dump", Options(table="nation"))[0])


@query("SELECT * FROM (VALUES ('created', 't', 'a|b'), ('listed', 'u', 'x|y'), ('bare', 'v', 'c0|c1|c2'), ('missing', '', 'table ''w'' is not in the dump; it has: t')) q(dump, name, columns)")
def sqldump_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table without rows, of one that only its rows name, of one that nothing names, and a table that isn't there."""
    dumps = {"created": "CREATE TABLE t (a int, b text);", "listed": "INSERT INTO u (x, y) VALUES (1, 2);", "bare": "INSERT INTO v VALUES (1, 2, 3);"}
    rows = [(k, *((found := sqldump.schema(put(spark, f"{k}.sql", [text])))[0], "|".join(found[1]))) for k, text in dumps.items()]
    rows.append(("missing", "", refused(sqldump.schema, put(spark, "m.sql", [dumps["created"]]), "w")))
    return spark.createDataFrame(rows, "dump string, name string, columns string")


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END AS one, '2.5' AS v FROM nation")
def sheet_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows
    text = lambda v: f'<c office:value-type="string"><p>{v}</p></c>'.replace("<c ", "<table-cell ").replace("</c>", "</table-cell>")
    other = lambda kind, name, v: f'<table-cell office:value-type="{kind}" office:{name}="{v}"/>'
    lines = [[text(x) for x in ("k", "name", "one", "v")]] + [[other("float", "value", r[0]), text(r[1]), other("boolean", "boolean-value", str(r[2] == 1).lower()), other("percentage", "value", 2.5)] for r in rows]
    body = "".join(f"<table-row>{''.join(x)}</table-row>" for x in lines)
    path = folder(spark) / "n.ods"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<document xmlns:office="urn:o"><table>{body}<table-row number-rows-repeated="9000"/></table></document>')
    return named(open_source(spark, str(path), "ods", Options())[0])


@query("SELECT * FROM (VALUES ('CSV', 'csv'), ('jsonl', 'json'), ('dump', 'sql'), ('ods', 'sheet'), ('mdb', 'unknown source format ''mdb''')) t(name, kind)")
def format_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["CSV", "jsonl", "dump", "ods", "mdb"]
    return spark.createDataFrame([(n, refused(source_format, n) or source_format(n)) for n in names], "name string, kind string")


# Charsets

@query("SELECT c_custkey, c_name || ' ñ日' AS c_name FROM customer")
def utf16_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in UTF-16 with its mark, found without being told."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").toLocalIterator()
    path = put(spark, "c.csv", (x for part in (iter(["c_custkey,c_name\r\n"]), (f"{k},{n} ñ日\r\n" for k, n in rows)) for x in part), "utf-16")
    return typed(open_delimited(spark, path, Options()), [INT, TEXT])


@query("SELECT * FROM (VALUES ('windows-1251'), ('windows-1252'), ('shift_jis'), ('utf-8'), ('utf-16le'), ('not a label: klingon')) t(label)")
def detected_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"cp1251": "Широкая электрификация южных губерний даст мощный толчок", "cp1252": "Voix ambiguë d'un cœur qui au zéphyr préfère les jattes de kiwis", "cp932": "いろはにほへと ちりぬるを わかよたれそ", "utf-8": "Größe, ñandú", "utf-16": "two bytes"}
    found = [charset.detect_encoding(t.encode(c)) for c, t in texts.items()]
    bad = "not a label: klingon" if refused(charset.single_byte, "klingon") else ""
    return spark.createDataFrame([(x,) for x in [*found, bad]], "label string")


# Sinks and conversions

@query("SELECT codec, (SELECT count(*) FROM customer) AS n FROM (VALUES ('zstd'), ('gzip'), ('brotli'), ('snappy'), ('lz4'), ('none')) t(codec)")
def parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each codec's output, read back and compared with what was written."""
    df = table(spark, sf_dir, "customer")
    wanted, out = df.agg(*file_sinks.digest(df)).first().asDict(), folder(spark)
    rows = []
    for codec in file_sinks.CODECS:
        file_sinks.write_parquet(df, str(out / codec), Options(codec=codec))
        rows.append((codec, file_sinks.verify(spark, wanted, str(out / codec), codec)))
    return spark.createDataFrame(rows, "codec string, n long")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN c_name || ',' ELSE c_name END AS name, c_acctbal AS balance FROM customer")
def convert_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to typed Parquet by a whole conversion, with its read-back check."""
    name = F.when(F.col("c_custkey") % 9 == 0, F.concat("c_name", F.lit(","))).otherwise(F.col("c_name"))
    lines = text_lines(table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_custkey"), name, F.col("c_acctbal")], ["k", "name", "balance"])
    out = folder(spark)
    lines.select("value").write.text(str(out / "in.csv"))
    done = convert(spark, str(out / "in.csv"), str(out / "out"), "csv", "parquet", Options(infer_types=True, encoding="utf-8"))
    return spark.read.parquet(done.path)


@query("SELECT * FROM (VALUES ('o', 'csv', 'o.csv'), ('o.csv', 'csv', 'o.csv'), ('o', 'parquet', 'o.parquet'), ('o.x', 'sqlite', 'o.x.db')) t(given, target, path)")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("o", "csv"), ("o.csv", "csv"), ("o", "parquet"), ("o.x", "sqlite")]
    return spark.createDataFrame([(g, t, output_path(g, t)) for g, t in given], "given string, target string, path string")


# Doctor

@query(
    "SELECT * FROM (VALUES ('short rows', 'join_lines', 'suggestion'), ('more cells', 'realign', 'suggestion'), ('no header', 'no_headers', 'suggestion'), "
    "('wrong charset', 'fallback_encoding', 'suggestion'), ('utf-8 as single bytes', 'encoding', 'safe')) t(damage, fix, level)"
)
def doctor_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in files with one kind of damage each."""
    rows = [f"{r[0]},{r[1]},{r[2]}" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    text = lambda lines: ("k,name,r\n" + "\n".join(lines) + "\n").encode()
    cases = {
        "short rows": (text([*rows, "90,broken", "name,1"]), {}, "join_lines"),
        "more cells": (text([*rows, "90,a, b,1"]), {}, "realign"),
        "no header": (("\n".join(rows) + "\n").encode(), {}, "no_headers"),
        "wrong charset": ("k,name,r\n1,Besançon à côté,2\n".encode("cp1252"), {"encoding": "utf-8"}, "fallback_encoding"),
        "utf-8 as single bytes": ("k,name,r\n1,Besançon à côté,2\n".encode(), {"encoding": "windows-1252"}, "encoding"),
    }
    out = []
    for damage, (data, given, fix) in cases.items():
        found = examine_bytes(spark, data, Options(**given)).frame(spark).filter(F.col("fix") == fix).select("fix", "level").distinct().collect()
        out += [(damage, r["fix"], r["level"]) for r in found]
    return spark.createDataFrame(out, "damage string, fix string, level string")
