"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.session import ensure_checkpoint_dir

# Bytes of text that one vectorised step inside a task works on.
SLICE_BYTES = 4 << 20

UPPER_TO_LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken) -> str:
    """`name`, or a variant of it that no column of `taken` uses."""
    used = {c.lower() for c in taken}
    out = name
    while out.lower() in used:
        out = "_" + out
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the folder in spark.checkpoint.dir and read it back.

    Later stages read the written table, so a lost executor never sends them
    back to the start. The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A value of bounded size, broadcast once; `get()` gives it in a task."""

    def __init__(self, spark: SparkSession, value):
        # Pickled here: a plain broadcast would look for the value's class on the executors.
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return cloudpickle.loads(self.sent.value)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def cuts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField],
                maker: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `df` (default all) plus `fields`, computed from `text`.

    `maker` runs once a task and returns a function from a list of UTF-8 texts
    (None for null) to one Arrow array for each field. Rows stay where they are:
    no shuffle, and a task holds one slice of texts at a time.
    """
    kept = list(df.columns if keep is None else keep)
    sent = kept if text in kept else [*kept, text]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names, at, n_kept = schema.names, sent.index(text), len(kept)

    def run(batches):
        work = maker()
        for batch in batches:
            for lo, hi in cuts(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                made = work(as_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_kept)] + made, names=names)

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of `key`, equal hashes by key: the same ones in
    every run, if keys are unique.

    The rows are counted first, and only the share with hashes low enough to give about four times
    as many as wanted is sorted, so the one task that takes the smallest never gets the input.
    """
    place = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    cells = 1 << 40
    low = min(cells, cells * 4 * rows // max(1, df.count()))
    return df.where(F.pmod(place, F.lit(cells)) < low).orderBy(F.pmod(place, F.lit(cells)), place, key).limit(rows)
