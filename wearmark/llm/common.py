"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder

# Rows of a single long id (with its overhead) that a forced broadcast may hold.
BROADCAST_ROWS = 1_000_000
# Bytes of texts that a Python worker gets at a time.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
# Rows that share one key and are numbered by one task.
RANK_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors do not repeat it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wearmark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(df: DataFrame) -> None:
    """Remove the files behind a table made by ``written`` once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows are under the bound; otherwise leave the join to shuffle.

    ``df`` should be a written table, as it is counted first.
    """
    return F.broadcast(df) if df.count() <= rows else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session was started with a bound of its own.

    Spark's default lets a batch of whole texts grow to 64 MB, several times
    over on both sides of a worker.
    """
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def worker_state(name: str, make: Callable[[], object]):
    """What the tasks of one reused Python worker share under ``name``; made by ``make`` when first asked for.

    Functions travel to workers by value, so their modules hold nothing from
    task to task; a module of our own in the worker does.
    """
    held = vars(sys.modules.setdefault("_corpus_worker", types.ModuleType("_corpus_worker")))
    return held[name] if name in held else held.setdefault(name, make())


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a ``mapInArrow``, after which the reused worker gives its freed memory back to the machine."""

    def with_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # only glibc has it
                pass

    return with_release


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str | Column = "text") -> Column:
    """Number of runs without ASCII white space; null counts 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], spread: Sequence[str], out: str = "_rank"
) -> DataFrame:
    """Gapless 0-based number of each row among the rows with its ``keys``.

    A key may hold any share of the rows: each key is cut into salts by a hash
    of the ``spread`` columns, as many as its count asks for, rows are numbered
    within a salt and the counts of earlier salts are added. Equal rows are
    interchangeable, so reruns give the same set of rows. ``df`` is read twice.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # salts per key: one per RANK_ROWS rows, known before the rows are dealt out
    salted = df.withColumn("_h", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(1 << 20)))
    salted = salted.join(
        sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_n") / RANK_ROWS).alias("_salts")),
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
    ).drop(*[f"_k_{k}" for k in keys])
    salted = salted.withColumn("_salt", F.pmod(F.col("_h"), F.col("_salts"))).drop("_h", "_salts")
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_salt").alias("_k_salt"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_within", F.row_number().over(within) - 1)
    return (
        numbered.join(
            starts,
            [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_k_salt")],
        )
        .withColumn(out, (F.col("_start") + F.col("_within")).cast("long"))
        .drop(*[f"_k_{k}" for k in keys], "_k_salt", "_salt", "_within", "_start")
    )
