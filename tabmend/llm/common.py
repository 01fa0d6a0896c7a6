"""Shared helpers: reading tables, shared-folder checkpoints, token hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed at once; longer texts are cut at white space.
CHUNK = 1 << 18
#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows and bytes that a Python worker gets at once, so that long texts don't add up.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller setting stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more: Spark removes them once the driver's heap is collected, which may take half an hour by itself."""
    spark.range(1).write.format("noop").mode("overwrite").save()  # the last write's plan is held until another comes
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, but only if all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tabmend-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders that `materialize` wrote, in order.
WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # snappy's buffers lie outside the heap until a collection frees them
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that `materialize` wrote and no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        WRITTEN.remove(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    step = base & (2**64 - 1)
    while filled < n:  # doubles the filled part
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step & (2**64 - 1)
    return out


class TokenHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of UTF-8 bytes."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.lower = np.frombuffer(LOWER, np.uint8).astype(np.uint64) + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self._grow(CHUNK + 1)

    def _grow(self, n: int) -> None:
        self.up = _powers(self.BASE, n)
        self.down = _powers(pow(self.BASE, -1, 2**64), n)

    def hashes(self, data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes and byte starts; a token ends at white space or where a row starts."""
        if not len(data):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(data) >= len(self.up):
            self._grow(len(data) + 1)
        word = ~self.space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[row_starts] = True
        cut[0] = cut[-1] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | cut[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | cut[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.lower[data] * self.up[: len(data)], out=prefix[1:])
        return mix((prefix[e] - prefix[s]) * self.down[s] + (e - s).astype(np.uint64)), s

    def rows(self, column: pa.Array):
        """Yield (first row, last row + 1, token hashes, row of each token) over bounded pieces of a column.

        A row longer than CHUNK comes alone, hashed in segments that end at white space.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return
        _, offs, body = column.buffers()
        offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        at, n = 0, len(column)
        while at < n:
            stop = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
            if stop <= at:
                yield at, at + 1, *self._long(data[offsets[at] : offsets[at + 1]], at)
                at += 1
                continue
            stop = min(stop, n)
            first = offsets[at]
            rel = offsets[at : stop + 1] - first
            tokens, starts = self.hashes(data[first : offsets[stop]], rel)
            yield at, stop, tokens, at + np.searchsorted(rel, starts, side="right") - 1
            at = stop

    def _long(self, data: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        while at < len(data):
            stop = min(at + CHUNK, len(data))
            while stop < len(data):
                gaps = np.flatnonzero(self.space[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                stop = min(stop + CHUNK, len(data))  # one word fills the segment
            parts.append(self.hashes(data[at:stop], np.zeros(1, np.int64))[0])
            at = stop
        tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return tokens, np.full(len(tokens), row, np.int64)


def shingle_hashes(tokens: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where there are fewer words."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    width = min(k, n)
    h = tokens[: n - width + 1].copy()
    for j in range(1, width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + tokens[j : n - width + 1 + j]
    return np.unique(mix(h + np.uint64(width)))


def sequence_keys(tokens: np.ndarray) -> bytes:
    """A 128-bit key of a token sequence."""
    order = mix(np.arange(1, len(tokens) + 1, dtype=np.uint64))
    a = np.add.reduce(mix(tokens + order), dtype=np.uint64)
    b = np.add.reduce(mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F) ^ order), dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b ^ np.uint64(len(tokens))).to_bytes(8, "big")
