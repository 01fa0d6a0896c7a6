"""Queries of the library's operators over the test tables, and their DuckDB SQL.

Damage is made from clean tables by fixed rules, then repaired by the operators, so
that SQL over the clean tables says what must come out.
"""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.functions import charset
from tabmend.functions.typed import BOOL, FLOAT, INT, TEXT, coerce, parse_bool, parse_float, parse_int
from tabmend.metrics import measured
from tabmend.operators.guard import guard, kept
from tabmend.operators.infer import describe_types, infer_carrier_types, mismatch_counts, typed_columns
from tabmend.operators.names import unique_names
from tabmend.operators.repair import drop_trailing, join_broken, realign
from tabmend.options import Options
from tabmend.plans.doctor import delimiter_profile, examine_bytes
from tabmend.search import lookup_all, postings, search_all
from tabmend.sinks import files as file_sinks
from tabmend.sinks.sqlitedb import load
from tabmend.sources import sqlitedb
from tabmend.sources.columnar import parquet_schema, parquet_text, rows_at
from tabmend.sources.files import read_cells
from tabmend.sources.jsontext import json_columns, json_rows
from tabmend.sources.lines import from_text, open_delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> Path:
    """A folder for outputs: the shared one of a cluster, or else, where all runs on this machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = Path(shared.removeprefix("file://").removeprefix("file:")) if shared and "://" not in shared.removeprefix("file://") else None
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is not None:
        base.mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="tabmend-", dir=base))


def text_lines(df: DataFrame, key: str, columns: list[Column], header: list[str], sep: str = ",", changed: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(at, value): a header line and one delimited line for each row, quoted where the sign, a quote or a line break is inside."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike(f'[{sep}"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    body = df.select(F.col(key).cast("long").alias("at"), changed(F.concat_ws(sep, *(cell(c) for c in columns))).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit(sep.join(header)).alias("value"))
    return head.unionByName(body)


def write_pieces(lines: DataFrame, path: str, first: str, between: str, last: str, lead: str = "") -> str:
    """A folder with a file for each task's texts, which `between` parts, written side by side. Each starts and ends as given."""
    column = lines.columns[0]

    def run(batches):
        before = first
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array([before + between.join(batch.column(0).to_pylist())])], [column])
                before = lead
        yield pa.record_batch([pa.array([last if before == lead else first + last])], [column])

    lines.mapInArrow(run, f"{column} string").write.text(path)
    return path


def typed(opened, kinds: list[str], options: Options | None = None) -> DataFrame:
    clean = kept(guard(opened.carrier, opened.width, options or Options()))
    return clean.select(*typed_columns([F.get("cells", F.lit(i)) for i in range(opened.width)], opened.names, kinds))


def cells_of(df: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """A carrier of a table's rows in the order of a key."""
    from tabmend.operators.carrier import from_rows

    cells = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return from_rows(df.select(F.col(key).alias("at"), cells.alias("cells")), ["at"]).drop("at")


def cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


# Delimited text

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
LINE_KINDS = [INT, INT, FLOAT, FLOAT, FLOAT, TEXT, TEXT]


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of lineitem: every 7th order's end in a stray quote, every 11th's in a spare delimiter."""
    df = table(spark, sf_dir, "lineitem")
    lines = text_lines(df.withColumn("k", F.col("l_orderkey") * 16 + F.col("l_linenumber")), "k", [F.col(c) for c in LINE_COLUMNS], LINE_COLUMNS)
    key = F.floor(F.col("at") / 16)
    spare = F.when(F.col("at") < 0, "").when(key % 7 == 0, '"').when(key % 11 == 0, ",").otherwise("")
    return lines.withColumn("value", F.concat("value", spare))


def cleaned_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines written as a file, then repaired, inferred and typed."""
    options = Options(trailing_delimiter=True, trim='"', encoding="utf-8")
    path = str(folder(spark) / "lineitem.csv")
    dirty_lineitem(spark, sf_dir).select("value").write.text(path)
    opened = open_delimited(spark, path, options)
    kinds = infer_carrier_types(kept(guard(opened.carrier, opened.width, options)), opened.width)
    return typed(opened, kinds, options)


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, "
    "round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem GROUP BY ALL"
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned_lineitem(spark, sf_dir)
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return typed(from_text(text_lines(df, "c_custkey", [F.col(c) for c in df.columns], df.columns), ["at"], Options()), [INT, TEXT, INT, FLOAT, TEXT])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '\"\"' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def quote_repair_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    lines = text_lines(table(spark, sf_dir, "orders"), "o_orderkey", [F.col(c) for c in names], names)
    lines = lines.withColumn("value", F.when((F.col("at") >= 0) & (F.col("at") % 7 == 0), F.concat("value", F.lit('"'))).otherwise(F.col("value")))
    return typed(from_text(lines, ["at"], Options()), [INT, TEXT, TEXT])


@query("SELECT count(*) FILTER (o_orderkey % 7 = 0) AS quotes, count(*) AS n FROM orders")
def quote_repair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(table(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_orderkey"), F.col("o_orderstatus")], ["k", "s"])
    lines = lines.withColumn("value", F.when((F.col("at") >= 0) & (F.col("at") % 7 == 0), F.concat("value", F.lit('"'))).otherwise(F.col("value")))
    opened = from_text(lines, ["at"], Options())
    return opened.carrier.agg(F.sum("n_quote").cast("long").alias("quotes"), F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents")
def multiline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(table(spark, sf_dir, "documents"), "doc_id", [F.col("doc_id"), F.col("text")], ["doc_id", "text"])
    pieces = lines.select("at", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return typed(from_text(pieces, ["at", "line"], Options(repair=False)), [INT, TEXT])


@query("SELECT n_nationkey::BIGINT AS k, '\"' || n_name AS a, 'x\"' AS b FROM nation")
def no_quote_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    lines = df.select(F.col("n_nationkey").cast("long").alias("at"), F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit(',x"')).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([(-1, "k,a,b")], "at long, value string"))
    return typed(from_text(lines, ["at"], Options(quoting=False)), [INT, TEXT, TEXT])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def trailing_delim_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["s_suppkey", "s_name", "s_acctbal"]
    lines = text_lines(table(spark, sf_dir, "supplier"), "s_suppkey", [F.col(c) for c in names], [*names, ""]).withColumn("value", F.when(F.col("at") >= 0, F.concat("value", F.lit(","))).otherwise(F.col("value")))
    return typed(from_text(lines, ["at"], Options(trailing_delimiter=True)), [INT, TEXT, FLOAT])


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || 'more' ELSE p_name END AS p_name, p_size::BIGINT AS p_size FROM part")
def join_lines_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["p_partkey", "p_name", "p_size"]
    broken = F.when(F.col("p_partkey") % 5 == 0, F.array(F.concat_ws(",", "p_partkey", "p_name"), F.concat_ws(",", F.lit("more"), "p_size"))).otherwise(F.array(F.concat_ws(",", "p_partkey", "p_name", "p_size")))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.posexplode(broken).alias("line", "value"))
    lines = lines.unionByName(spark.createDataFrame([(-1, 0, ",".join(names))], "at long, line int, value string"))
    return typed(from_text(lines, ["at", "line"], Options(join_lines=True)), [INT, TEXT, INT])


@query("SELECT c_custkey, replace(c_name, '#', ',') AS c_name, c_acctbal FROM customer")
def realign_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit(",")))
    rows = df.select("c_custkey", F.split(F.concat_ws(",", "c_custkey", "c_name", "c_acctbal"), ",").alias("cells"))
    from tabmend.operators.carrier import from_rows

    # clean rows teach the types; they are told apart by keys below the table's and left out again
    taught = spark.range(-60, 0).select(F.col("id").alias("c_custkey"), F.array(F.col("id").cast("string"), F.lit("name"), F.lit("1.5")).alias("cells"))
    carrier = from_rows(rows.unionByName(taught), ["c_custkey"])
    fixed = realign(carrier.drop("c_custkey"), 3, ",")
    return fixed.select(*typed_columns([cell(0), cell(1), cell(2)], ["c_custkey", "c_name", "c_acctbal"], [INT, TEXT, FLOAT])).filter("c_custkey >= 0")


# Guard

def odd_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    full = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    k = F.col("o_orderkey")
    cells = F.when(k % 5 == 0, F.slice(full, 1, 2)).when(k % 5 == 1, F.concat(full, F.array(F.lit("x"), F.lit("y")))).when(k % 97 == 2, F.concat(full, F.array_repeat(F.lit("z"), F.lit(4094)))).otherwise(full)
    return df.select(k.alias("pos"), cells.alias("cells"))


GUARDED = "FROM orders WHERE NOT (o_orderkey % 5 NOT IN (0, 1) AND o_orderkey % 97 = 2)"


@query(f"SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS p {GUARDED}")
def guard_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = kept(guard(odd_widths(spark, sf_dir), 3, Options()))
    return clean.select(*typed_columns([cell(0), cell(1), cell(2)], ["k", "s", "p"], [INT, TEXT, TEXT]))


@query(f"SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 97 = 2) AS malformed {GUARDED}")
def guard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(guard(odd_widths(spark, sf_dir), 3, Options()))
    return spark.createDataFrame([(m.rows, m.counts["malformed"])], "n long, malformed long")


@query("SELECT doc_id, trim(text, 'AEIOTaeiot. ') AS text FROM documents")
def guard_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.array("text").alias("cells"))
    return kept(guard(df, 1, Options(trim="AEIOTaeiot. "))).select(F.col("pos").alias("doc_id"), cell(0).alias("text"))


@query("SELECT doc_id, left(text, 17) AS text FROM documents")
def guard_max_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.array("text").alias("cells"))
    return kept(guard(df, 1, Options(max_field=17))).select(F.col("pos").alias("doc_id"), cell(0).alias("text"))


# Types

SQL_INT = r"CASE WHEN regexp_full_match(c, '0|-?[1-9][0-9]*') THEN try_cast(c AS BIGINT) END"
SQL_MIXED = (
    "(SELECT event_id, unnest([event_id::VARCHAR, '0' || event_id::VARCHAR, '-' || event_id::VARCHAR, event_id::VARCHAR || '.5', '1e' || (event_id % 7)::VARCHAR, "
    "event_type, CASE WHEN event_id % 3 = 0 THEN 'TRUE' WHEN event_id % 3 = 1 THEN 'False' ELSE '' END, '9223372036854775807', '9223372036854775808', '0.12345678901234567']) AS c FROM events)"
)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 3
    cells = [e, F.concat(F.lit("0"), e), F.concat(F.lit("-"), e), F.concat(e, F.lit(".5")), F.concat(F.lit("1e"), (F.col("event_id") % 7).cast("string")), F.col("event_type"), F.when(k == 0, "TRUE").when(k == 1, "False").otherwise(""), F.lit("9223372036854775807"), F.lit("9223372036854775808"), F.lit("0.12345678901234567")]
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*cells)).alias("c"))


@query(f"SELECT event_id, c, coalesce(({SQL_INT})::VARCHAR, '') AS v FROM {SQL_MIXED}")
def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("event_id", "c", F.coalesce(parse_int(F.col("c")).cast("string"), F.lit("")).alias("v"))


@query(
    r"SELECT event_id, c, CASE WHEN regexp_full_match(c, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND c <> '-0' "
    rf"AND CASE WHEN regexp_full_match(c, '-?[0-9]+') THEN abs(try_cast(c AS HUGEINT)) <= 9007199254740992 ELSE length(regexp_replace(c, '[eE.-].*', '')) <= 15 AND c <> '0.12345678901234567' END THEN try_cast(c AS DOUBLE) END AS v FROM {SQL_MIXED}"
)
def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("event_id", "c", parse_float(F.col("c")).alias("v"))


@query(f"SELECT event_id, c, CASE WHEN lower(c) IN ('true', 'false') THEN lower(c) ELSE '' END AS v FROM {SQL_MIXED}")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("event_id", "c", F.coalesce(parse_bool(F.col("c")).cast("string"), F.lit("")).alias("v"))


def inferred(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    df = table(spark, sf_dir, name)
    carrier = df.select(F.monotonically_increasing_id().alias("pos"), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("cells"))
    kinds = infer_carrier_types(carrier, len(columns), 10**9)
    return spark.createDataFrame(list(zip(columns, kinds, strict=True)), "name string, kind string")


@query("SELECT * FROM (VALUES ('l_orderkey', 'int'), ('l_linenumber', 'int'), ('l_quantity', 'float'), ('l_discount', 'float'), ('l_returnflag', 'text'), ('l_shipdate', 'text')) t(name, kind)")
def infer_types_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"])


@query("SELECT * FROM (VALUES ('event_id', 'int'), ('user_id', 'int'), ('event_type', 'text'), ('props', 'text')) t(name, kind)")
def infer_types_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"])


@query("SELECT * FROM (VALUES ('3 int, 1 float, 0 bool, 1 text')) t(types)")
def describe_types_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r["kind"] for r in inferred(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]).collect()]
    return spark.createDataFrame([(describe_types([*kinds, INT]),)], "types string")


@query(rf"SELECT count(*) FILTER (c <> '' AND ({SQL_INT}) IS NULL) AS int_misfits, count(*) FILTER (c <> '' AND lower(c) NOT IN ('true', 'false')) AS bool_misfits FROM {SQL_MIXED}")
def mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mismatch_counts(mixed(spark, sf_dir), [F.col("c"), F.col("c")], [INT, BOOL])
    return spark.createDataFrame([tuple(counts)], "int_misfits long, bool_misfits long")


@query("SELECT * FROM (VALUES (0, 'Id', 'Id'), (1, 'id', 'id_1'), (2, 'c2', 'c2'), (3, 'ID', 'ID_2'), (4, 'c2_1', 'c2_1')) t(i, plain, folded)")
def names_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [" Id", "id", "", "ID", "c2"]
    return spark.createDataFrame(list(zip(range(5), unique_names(given), unique_names(given, fold_case=True), strict=True)), "i int, plain string, folded string")


# Charsets

@query("SELECT doc_id, text FROM documents")
def fallback_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_decoded(table(spark, sf_dir, "documents"))


def fallback_decoded(df: DataFrame) -> DataFrame:
    data = F.coalesce(charset.encode_single_byte(F.col("text"), "windows-1252"), F.encode("text", "UTF-8"))
    raw = data.cast("string")
    back = F.when(F.is_valid_utf8(raw), raw).otherwise(charset.decode_single_byte(data, "windows-1252"))
    return df.select("doc_id", back.alias("text"))


@query("SELECT doc_id, text FROM documents")
def mojibake_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    wrong = charset.decode_single_byte(F.encode("text", "UTF-8"), "windows-1252")
    carrier = df.select(F.col("doc_id").alias("pos"), F.array(wrong).alias("cells"))
    return kept(guard(carrier, 1, Options(fix_mojibake="windows-1252"))).select(F.col("pos").alias("doc_id"), cell(0).alias("text"))


# JSON, Parquet, SQL dumps, SQLite

def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("part"), F.col("event_id").alias("pos"), F.col("props").alias("value"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS name FROM events")
def json_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in json_columns(event_json(spark, sf_dir))], "name string")


@query("SELECT event_id, e.key AS name, coalesce(e.value ->> '$', '') AS value FROM events, json_each(props) e")
def json_rows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = event_json(spark, sf_dir)
    names = json_columns(values)
    rows = json_rows(values, names)
    pairs = rows.select(F.col("pos").alias("event_id"), F.posexplode("cells").alias("i", "value"))
    return pairs.filter("value <> ''").select("event_id", F.get(F.array(*(F.lit(n) for n in names)), F.col("i")).alias("name"), "value")


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation")
def parquet_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, carrier = parquet_text(spark, f"{sf_dir}/nation.parquet")
    return carrier.select(cell(0).alias("a"), cell(1).alias("b"), cell(2).alias("c"))


@query("SELECT count(*) AS n, 6 AS columns FROM part")
def parquet_schema_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, n = parquet_schema(spark, f"{sf_dir}/part.parquet")
    return spark.createDataFrame([(n, len(names))], "n long, columns int")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 2")
def row_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_at(spark, f"{sf_dir}/supplier.parquet", [0, 1, 10**9]).select("s_suppkey", "s_name")


def recoded(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = str(folder(spark) / "o.parquet")
        file_sinks.recode(spark, f"{sf_dir}/{name}.parquet", out, Options())
        return spark.read.parquet(out)

    run.__name__ = f"recode_{name}"
    return query(f"SELECT * FROM {name}")(run)


for _name in ("customer", "part", "supplier", "region"):
    recoded(_name)


@query("SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p, o_totalprice::VARCHAR AS t FROM orders")
def sqldump_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumped_orders(spark, table(spark, sf_dir, "orders"))


def dumped_orders(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Dumps of the orders, a file for each part of the table."""
    text = F.concat(F.lit("'"), F.replace("o_orderpriority", F.lit("'"), F.lit("''")), F.lit("'"))
    values = F.format_string("INSERT INTO o VALUES (%s, %s, %s);", *(F.coalesce(c, F.lit("NULL")) for c in (F.col("o_orderkey").cast("string"), text, F.col("o_totalprice").cast("string"))))
    path = write_pieces(orders.select(values.alias("value")), str(folder(spark) / "d"), "CREATE TABLE `o` (k int, p text, t text);\n", "\n", "")
    return read_cells(spark, "sql", path, "o").select(cell(0).alias("k"), cell(1).alias("p"), cell(2).alias("t"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS n, n_regionkey::BIGINT AS r FROM nation")
def sqlite_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(folder(spark) / "n.db")
    rows = (tuple(r) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator())
    load(path, "n", ["k", "n", "r"], [INT, TEXT, INT], rows)
    back = read_cells(spark, "sqlite", path, sqlitedb.resolve(path, "n"))
    return back.select(*typed_columns([cell(0), cell(1), cell(2)], ["k", "n", "r"], [INT, TEXT, INT]))


@query("SELECT count(*) AS hits FROM part WHERE regexp_matches(lower(p_name), '\\bred\\b')")
def sqlite_full_text_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(folder(spark) / "p.db")
    rows = (tuple(r) for r in table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), "p_name").toLocalIterator())
    load(path, "p", ["k", "name"], None, rows)
    db = sqlite3.connect(path)
    hits = db.execute("SELECT count(*) FROM p WHERE p MATCH 'name:red'").fetchone()[0]
    db.close()
    shutil.rmtree(Path(path).parent)
    return spark.createDataFrame([(hits,)], "hits long")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_sink_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = str(folder(spark) / "o.csv")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    file_sinks.write_csv(df, out, Options(delimiter=";"))
    return typed_all(open_delimited(spark, out, Options(delimiter=";")), [INT, TEXT, FLOAT], "c_custkey")


def typed_all(opened, kinds: list[str], header: str) -> DataFrame:
    """Every part of a folder repeats the header."""
    cells = [F.get("cells", F.lit(i)) for i in range(opened.width)]
    return opened.carrier.filter(cells[0] != header).select(*typed_columns(cells, opened.names, kinds))


# Doctor and search

@query("SELECT d AS delimiter, (len(string_split(c_name || ',' || c_mktsegment, d)))::BIGINT AS width, count(*) AS n FROM customer, (VALUES (','), (';'), ('|'), (chr(9))) t(d) GROUP BY ALL")
def doctor_delimiter_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimiter_profile(table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_name", "c_mktsegment").alias("value")))


@query("SELECT * FROM (VALUES ('delimiter', ';', 'safe'), ('trailing_delimiter', 'True', 'safe')) t(fix, value, level)")
def doctor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "k;name;r\n" + "".join(f"{r[0]};{r[1]};{r[2]};\n" for r in rows)
    return examine_bytes(spark, text.encode(), Options()).frame(spark).filter("fix is not null").select("fix", "value", "level")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])and($|[^\\pL\\pN\\pM])') AND regexp_matches(lower(text), '(^|[^\\pL\\pN])that($|[^\\pL\\pN\\pM])')")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(table(spark, sf_dir, "documents"), ["text"], ["And", "that"]).select("doc_id")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '\\bred\\b') AND regexp_matches(lower(p_type), '\\beconomy\\b')")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"])
    return lookup_all(index, "p_partkey", ["red", "Economy"])


@query("SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def typed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned_lineitem(spark, sf_dir).createOrReplaceTempView("tabmend_lineitem")
    return spark.sql("SELECT l_returnflag, sum(l_quantity) AS qty FROM tabmend_lineitem GROUP BY l_returnflag")
