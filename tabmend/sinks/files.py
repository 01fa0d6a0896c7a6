"""CSV and Parquet outputs."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.options import ConversionError, Options

#: Codecs, their default levels and allowed levels; codecs without levels ignore one.
CODECS = {"zstd": (3, range(1, 23)), "gzip": (6, range(0, 10)), "brotli": (5, range(0, 12)), "snappy": None, "lz4": None, "none": None}
#: The JVM's names of gzip levels 0 to 9.
_GZIP_LEVELS = ["NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "DEFAULT_COMPRESSION", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"]
_SPARK_CODECS = {"zstd": "zstd", "gzip": "gzip", "snappy": "snappy", "lz4": "lz4_raw", "none": "none"}


def codec_level(codec: str, level: int | None) -> tuple[str, int | None]:
    if codec not in CODECS:
        raise ConversionError(f"unknown codec {codec!r}; there are {', '.join(CODECS)}")
    known = CODECS[codec]
    if known is None:
        return codec, None
    default, allowed = known
    if level is not None and level not in allowed:
        raise ConversionError(f"{codec} levels are {allowed.start} to {allowed.stop - 1}, not {level}")
    return codec, default if level is None else level


def write_csv(df: DataFrame, path: str, options: Options) -> None:
    """UTF-8 with a header, the input's delimiter and quotes where needed; a folder of parts, or one file."""
    writer = (df.coalesce(1) if options.single_file else df).write.mode("overwrite")
    writer = writer.options(header=True, sep=options.delimiter, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    _placed(writer.csv, path, options.single_file)


def write_parquet(df: DataFrame, path: str, options: Options) -> None:
    """Row groups of at most options.row_group rows, by Spark's writer; brotli by pyarrow in the same tasks."""
    codec, level = codec_level(options.codec, options.level)
    if codec == "brotli":
        if "://" in path:
            raise ConversionError(f"brotli files need a path that every machine can open, not {path}")
        _write_brotli(df, path, options.row_group, level)
        return
    writer = (df.coalesce(1) if options.single_file else df).write.mode("overwrite").option("compression", _SPARK_CODECS[codec])
    writer = writer.option("parquet.block.row.count.limit", options.row_group)
    if codec == "zstd":
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    elif codec == "gzip":
        writer = writer.option("zlib.compress.level", _GZIP_LEVELS[level])
    _placed(writer.parquet, path, options.single_file)


def _placed(write, path: str, single: bool) -> None:
    if not single:
        write(path)
        return
    folder = Path(f"{path}.{uuid.uuid4().hex}")
    try:
        write(str(folder))
        part = next(folder.glob("part-*"))
        if Path(path).is_dir():
            shutil.rmtree(path)
        part.replace(path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _write_brotli(df: DataFrame, path: str, row_group: int, level: int | None) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    stage = f"{path}.{uuid.uuid4().hex}"

    def run(batches):
        import pyspark

        context = pyspark.TaskContext.get()
        Path(stage).mkdir(parents=True, exist_ok=True)
        name = f"{stage}/part-{context.partitionId():05d}"
        writer, n = None, 0
        for batch in batches:
            if writer is None:
                writer = pq.ParquetWriter(f"{name}.{context.taskAttemptId()}", batch.schema, compression="brotli", compression_level=level)
            n += batch.num_rows
            writer.write_batch(batch, row_group_size=row_group)
        if writer is not None:
            writer.close()
            Path(f"{name}.{context.taskAttemptId()}").replace(f"{name}.parquet")  # a repeated task replaces its file
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(run, "n long").collect()
    shutil.rmtree(path, ignore_errors=True)
    Path(stage).mkdir(parents=True, exist_ok=True)
    Path(stage).replace(path)


def recode(spark: SparkSession, source: str, target: str, options: Options, names: list[str] | None = None) -> int:
    """Parquet to Parquet with types, NULLs and nested values as they are; the rows written, checked against the source."""
    df = spark.read.parquet(source)
    if names is not None:
        df = renamed(df, names)
    write_parquet(df, target, options)
    before, after = spark.read.parquet(source).count(), spark.read.parquet(target).count()
    if before != after:
        raise ConversionError(f"{after} of {before} rows were written")
    return after


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ConversionError(f"{len(names)} column names for {len(df.columns)} columns")
    return df.toDF(*names)


def recode_exact(spark: SparkSession, source: str, target: str, options: Options, names: list[str] | None = None) -> int:
    """The same for one file, keeping row group bounds and footer key-values: row group by row group, in one task."""
    codec, level = codec_level(options.codec, options.level)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for _ in batches:
            try:
                file = pq.ParquetFile(source)
            except pa.ArrowInvalid as error:
                raise ValueError(f"{source} is no Parquet file: {error}") from None
            kept = file.schema_arrow
            if names is not None:
                kept = pa.schema([f.with_name(n) for f, n in zip(kept, names, strict=True)], metadata=kept.metadata)
            staged = f"{target}.{uuid.uuid4().hex}"
            n = 0
            with pq.ParquetWriter(staged, kept, compression=codec, compression_level=level) as writer:
                for i in range(file.num_row_groups):
                    group = file.read_row_group(i)
                    writer.write_table(pa.Table.from_arrays(group.columns, schema=kept), row_group_size=max(1, group.num_rows))
                    n += group.num_rows
            Path(staged).replace(target)
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([file.metadata.num_rows], pa.int64())], ["n", "wanted"])

    n, wanted = spark.range(1, numPartitions=1).mapInArrow(run, "n long, wanted long").first()
    if n != wanted:
        raise ConversionError(f"{n} of {wanted} rows were written")
    return n


def digest(df: DataFrame) -> list[Column]:
    """Aggregates that tell tables of other rows apart: their number and the sum of their hashes."""
    cells = [F.to_json(f"`{c}`") if k.startswith(("map", "struct", "array")) else F.col(f"`{c}`") for c, k in df.dtypes]
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hashes")]


def verify(spark: SparkSession, wanted: dict, path: str, codec: str = "zstd") -> int:
    """Read an output back and compare its digest; for brotli, which Spark can't read here, the number of rows."""
    if codec == "brotli":
        import pyarrow.parquet as pq

        found = {"rows": sum(pq.read_metadata(p).num_rows for p in Path(path).glob("*.parquet"))}
    else:
        df = spark.read.parquet(path)
        found = df.agg(*digest(df)).first().asDict()
    if any(found[k] != wanted[k] for k in found):
        raise ConversionError(f"the output has {found['rows']} rows that differ from the {wanted['rows']} rows given")
    return found["rows"]
