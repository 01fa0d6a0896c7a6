"""Folders of delimited files that grow: each batch of new files runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.functions.typed import coerce
from tabmend.operators.guard import guard, kept
from tabmend.options import Options
from tabmend.sources.lines import close_quotes, records


def ingest_available(spark: SparkSession, folder: str, target: str, checkpoint: str, names: list[str], kinds: list[str], options: Options) -> None:
    """Repair and type the lines of new files in `folder` and append them to the Parquet table `target`; then stop.

    Lines are records here (quotes that stay open are closed at line ends), header lines
    are known by their text, and a batch that runs twice writes its own folder anew.
    """
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    header = options.delimiter.join(names)

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("part", F.spark_partition_id().cast("long")).withColumn("pos", F.monotonically_increasing_id()).withColumn("n_fallback", F.lit(0))
        if not options.no_headers:
            rows = rows.filter(F.rtrim(F.col("value"), F.lit("\r")) != header)
        rows = close_quotes(rows) if options.quoting and options.repair else rows.withColumn("n_quote", F.lit(0))
        clean = kept(guard(records(rows, options), len(names), options))
        typed = clean.select(*(coerce(F.get("cells", F.lit(i)), k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))
        typed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = lines.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(run).start()
    query.awaitTermination()
