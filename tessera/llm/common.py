"""What the operators share: table access, scratch tables in the shared folder, fixed hashes of ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own; on several machines that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder of the shared one, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _OURS:
        system, where = _hadoop(spark, folder)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _OURS.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


_OURS: set[str] = set()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    bounded_batches(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessera_path = path  # for drop_stored
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the tables behind ``stored`` DataFrames that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            system, where = _hadoop(df.sparkSession, path)
            system.delete(where, True)


#: Rows and bytes of a batch that goes to a Python worker, where the session has Spark's own larger values.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES, read_rows: int | None = None) -> None:
    """Bounds the batches that Python workers get, in rows and in bytes, so that long texts don't swell them, and the rows of a batch that Spark's Parquet reader
    decodes, if that is named. Values of the application, and smaller ones that a session has set, stay."""
    own = spark.sparkContext.getConf()
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most_bytes, "spark.sql.parquet.columnarReaderBatchSize": read_rows}
    for key, value in wanted.items():
        if value is None or own.contains(key):
            continue
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= value):
            spark.conf.set(key, str(value))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from all columns of ``df``, without regard to case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of an id written as decimal text, a long; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary"))


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(modulus))


#: Parts that a group is dealt to before its sample is drawn.
SALTS = 64


def ordered_sample(df: DataFrame, key: str, rows: int, *group: str) -> DataFrame:
    """At most ``rows`` rows (of each group, if named) with the smallest hash of ``key``: a bounded, repeatable sample.

    Groups are counted first. Rows meet their group's count in ``SALTS`` parts of each group, and only those whose hash is small
    for it are ranked, about four times as many as wanted: a hot group brings no task more rows than any other, at either step.
    """
    from pyspark.sql import Window

    mix, salt, size, rank, *of = fresh(df, "_mix", "_salt", "_size", "_rank", *(f"_of_{g}" for g in group))
    mixed = df.withColumn(mix, F.xxhash64(F.col(key).cast("string"), F.lit(7)))
    if not group:
        return mixed.orderBy(mix, key).limit(rows).drop(mix)
    sizes = df.groupBy(*(F.col(g).alias(o) for g, o in zip(group, of, strict=True))).agg(F.count(F.lit(1)).alias(size))
    sizes = sizes.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mixed = mixed.withColumn(salt, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(SALTS)).cast("int"))
    met = mixed.join(sizes, [F.col(salt) == F.col(f"{salt}_"), *(F.col(g) == F.col(o) for g, o in zip(group, of, strict=True))])
    few = met.filter((F.col(mix) / 2.0**64 + 0.5) * F.col(size) <= 4 * rows + 16).select(*df.columns, mix)
    ranked = few.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(mix, key)))
    return ranked.filter(F.col(rank) <= rows).drop(rank, mix)


#: Characters of the longest word that a worker remembers; longer ones are worked out each time, so what is remembered is bounded in bytes too.
LONGEST_KEPT = 64

_STATE: dict = {}


def worker_state(key, make):
    """What a worker process keeps for its operator between tasks, made by ``make()``. One slot: the next operator's state takes its place,
    and the memory goes back to the system, so a reused worker never holds several."""
    if key not in _STATE:
        _STATE.clear()
        _released()
        _STATE[key] = make()
    return _STATE[key]


def _released() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the GNU library; nothing depends on it
