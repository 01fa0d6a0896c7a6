"""One conversion: source, guard, names, types and sink, put together by format."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabmend.config import PREVIEW_ROWS
from tabmend.functions.typed import TEXT
from tabmend.metrics import Metrics, counters, measured, of_counters
from tabmend.operators.carrier import first_rows
from tabmend.operators.guard import guard, kept, warnings
from tabmend.operators.infer import MismatchReport, infer_carrier_types, mismatch_counts, require_fit, typed_columns
from tabmend.operators.names import output_names
from tabmend.options import ConversionError, Options
from tabmend.sinks import files as file_sinks
from tabmend.sinks.paths import output_path, require_distinct
from tabmend.sinks.sqlitedb import write_sqlite
from tabmend.sources import sheet, sqldump, sqlitedb
from tabmend.sources.columnar import parquet_text
from tabmend.sources.files import ROW_BITS, first_file, read_cells
from tabmend.sources.jsontext import open_json
from tabmend.sources.lines import Delimited, open_delimited

FORMATS = {"csv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "xlsx": "sheet", "xls": "sheet", "ods": "sheet", "sql": "sql", "dump": "sql", "parquet": "parquet", "sqlite": "sqlite"}
TARGETS = ("csv", "parquet", "sqlite")


def source_format(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ConversionError(f"unknown source format {name!r}")
    return FORMATS[name.lower()]


def open_source(spark: SparkSession, path: str, name: str, options: Options) -> tuple[Delimited, str]:
    """An opened source, and the table name that it suggests."""
    kind, table = source_format(name), options.table or "main"
    if kind == "csv":
        return open_delimited(spark, path, options), table
    if kind == "json":
        return open_json(spark, path), table
    if kind == "parquet":
        return Delimited(*parquet_text(spark, path)), table
    if kind == "sql":
        found, names = sqldump.schema(first_file(spark, path), options.table or "")
        return Delimited(names, read_cells(spark, "sql", path, found)), options.table or found
    if kind == "sqlite":
        found = sqlitedb.resolve(path, options.table)
        return Delimited(sqlitedb.columns(path, found), read_cells(spark, "sqlite", sqlitedb.database(path), found)), table
    names = sheet.header(first_file(spark, path), options.no_headers)
    rows = read_cells(spark, "sheet", path)
    return Delimited(names, rows if options.no_headers else rows.filter(F.col("pos") % (1 << ROW_BITS) > 0)), table


@dataclass
class Conversion:
    """A source made regular, before anything is written."""

    names: list[str]
    guarded: DataFrame
    options: Options
    table: str
    kinds: list[str] = field(default_factory=list)

    @property
    def carrier(self) -> DataFrame:
        return kept(self.guarded)

    def cells(self) -> list[Column]:
        return [F.get("cells", F.lit(i)) for i in range(len(self.names))]

    def infer(self) -> list[str]:
        self.kinds = infer_carrier_types(self.carrier, len(self.names), self.options.infer_rows)
        return self.kinds

    def frame(self) -> DataFrame:
        """The result as a DataFrame: typed columns where types were inferred, else text."""
        kinds = self.kinds or [TEXT] * len(self.names)
        return self.carrier.select(*typed_columns(self.cells(), self.names, kinds))

    def preview(self) -> DataFrame:
        return first_rows(self.carrier, PREVIEW_ROWS).select(*(F.left(c, F.lit(32)).alias(n) for c, n in zip(self.cells(), self.names, strict=True)))

    def observed(self) -> tuple[DataFrame, Watch]:
        """The frame, and what the pass that writes it has counted, so that no second pass is needed."""
        kinds = self.kinds or [TEXT] * len(self.names)
        rows, values, digest = Observation(), Observation(), Observation()
        carrier = kept(self.guarded.observe(rows, *counters(self.guarded)))
        raw = carrier.select(F.col("cells").alias("_cells"), *typed_columns(self.cells(), self.names, kinds))
        lost = [F.coalesce(F.count_if((F.get("_cells", F.lit(i)) != "") & F.col(f"`{n}`").isNull()), F.lit(0)).alias(f"m{i}") for i, (n, k) in enumerate(zip(self.names, kinds, strict=True)) if k != TEXT]
        frame = raw.observe(values, F.count("*").alias("n"), *lost).drop("_cells")
        return frame.observe(digest, *file_sinks.digest(frame)), Watch(self, kinds, rows, values, digest)

    def metrics(self) -> Metrics:
        return measured(self.guarded)

    def mismatches(self) -> MismatchReport:
        counts = mismatch_counts(self.carrier, self.cells(), self.kinds) if self.kinds else []
        return MismatchReport(self.names if self.kinds else [], self.kinds, counts)


@dataclass
class Watch:
    """Counters of a pass that has run."""

    made: Conversion
    kinds: list[str]
    rows: Observation
    values: Observation
    digest: Observation

    def outcome(self) -> tuple[Metrics, MismatchReport]:
        metrics, lost = of_counters(self.rows.get), self.values.get
        report = MismatchReport(self.made.names, self.kinds, [lost.get(f"m{i}", 0) for i in range(len(self.kinds))])
        metrics.mismatches = report.total
        return metrics, report


def prepare(spark: SparkSession, path: str, name: str, options: Options, fold_names: bool = False) -> Conversion:
    opened, table = open_source(spark, path, name, options)
    names = output_names(opened.names, options.columns, fold_names)
    return Conversion(names, guard(opened.carrier, opened.width, options), options, table)


def is_recode(source: str, target: str, options: Options) -> bool:
    """Parquet to Parquet stays typed unless cells have to be looked at; mojibake repair does look at them."""
    return source_format(source) == "parquet" and target == "parquet" and not (options.trim or options.max_field or options.infer_types or options.fix_mojibake)


@dataclass
class Outcome:
    path: str
    metrics: Metrics
    messages: list[str]


def convert(spark: SparkSession, source: str, target_path: str, source_kind: str, target: str, options: Options, confirm=None) -> Outcome | None:
    """Run a conversion; None where `confirm(preview)` says no, in which case nothing was touched."""
    if target not in TARGETS:
        raise ConversionError(f"unknown target {target!r}; there are {', '.join(TARGETS)}")
    kind = source_format(source_kind)
    if kind == "sqlite" and target == "sqlite":
        raise ConversionError("a SQLite source cannot be written to SQLite")
    path = output_path(target_path, target)
    require_distinct(sqlitedb.database(source) if kind == "sqlite" else source, path)
    if is_recode(source_kind, target, options):
        df = spark.read.parquet(source)
        names = output_names(df.columns, options.columns)
        if confirm and not confirm(df.toDF(*names).limit(PREVIEW_ROWS)):
            return None
        # row groups and footer entries belong to a file; a folder's files are rewritten in parallel by Spark
        exact = Path(source).is_file()
        n = (file_sinks.recode_exact if exact else file_sinks.recode)(spark, source, path, options, names)
        return Outcome(path, Metrics(n), [])
    made = prepare(spark, source, source_kind, options, fold_names=target == "sqlite")
    if options.count and kind == "sqlite":
        found = sqlitedb.resolve(source, options.table)
        print(f"{sqlitedb.row_count(source, found)} rows in table {found}")
    if confirm and not confirm(made.preview()):
        return None
    typed = options.infer_types if target == "parquet" else target == "sqlite" and options.sqlite_mode == "typed"
    if typed:
        made.infer()
        if options.strict:
            require_fit(made.carrier, made.names, made.kinds)
    if target == "sqlite":
        write_sqlite(made.carrier, path, made.table, made.names, made.kinds or None, options.drop_table, options.row_group)
        report, metrics = made.mismatches(), made.metrics()
        metrics.mismatches = report.total
    else:
        frame, watch = made.observed()
        (file_sinks.write_csv if target == "csv" else file_sinks.write_parquet)(frame, path, options)
        metrics, report = watch.outcome()
        if target == "parquet":
            file_sinks.verify(spark, watch.digest.get, path, options.codec)
    bad = warnings(made.guarded, len(made.names)) if metrics.counts.get("malformed") else []
    return Outcome(path, metrics, [*bad, *report.warnings()])
