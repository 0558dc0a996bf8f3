"""Small helpers shared by the operators: column hygiene, spread, cutting lineage, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.checkpoints import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's own shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate data; a temporary one only where none is set, in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_SCRATCH: list[list[str]] = []
DONE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Executions inside the block remove their shuffle files when they end, not when the driver happens to collect garbage."""
    before = spark.conf.get(DONE_SHUFFLES, None)
    spark.conf.set(DONE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DONE_SHUFFLES)
        else:
            spark.conf.set(DONE_SHUFFLES, before)


def _stored(df: DataFrame, level: int) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/keyloom-{uuid.uuid4().hex}"
    if len(_SCRATCH) >= level:
        _SCRATCH[-level].append(path)
    with _without_leftovers(df.sparkSession):  # a stored table is never made again from its shuffles
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and go on from there: no lineage, no lost blocks."""
    return _stored(df, 1)


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut` for the result of a :func:`scratch` block: it outlives the block."""
    return _stored(df, 2)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside the block are removed at its end; what it returns has to be :func:`kept`."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in map(jvm.org.apache.hadoop.fs.Path, _SCRATCH.pop()):
            path.getFileSystem(conf).delete(path, True)


ROW = "_row_key"


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a key of each row in ``ROW``, stored once: every later read finds the same keys.

    Keys ascend in the order of the input. Rows that have keys already keep them.
    """
    return rows if ROW in rows.columns else cut(rows.withColumn(ROW, F.monotonically_increasing_id()))


def ids_are_keys(rows: DataFrame) -> bool:
    """Whether each row has a doc_id that no other has; counts are pre-aggregated in the tasks."""
    return rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty()


def with_keys(rows: DataFrame) -> DataFrame:
    """:func:`keyed`, but ids that are unique serve as keys, and nothing has to be stored."""
    return rows.withColumn(ROW, F.col("doc_id").cast("long")) if ids_are_keys(rows) else keyed(rows)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows`` as they are; sees to it that Arrow batches hold ``TEXT_ROWS`` whole texts, not Spark's 10,000.

    A session that has set its own number keeps it.
    """
    conf = rows.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, TEXT_ROWS)
    return rows


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a long, b long).

    Alternating large-star and small-star rounds: every round keeps at most one edge per
    node and neighbour, a hub's neighbours are never gathered in one row, and each round
    is written to the shared folder. Empty input gives an empty table.
    """
    edges = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    stars = edges
    while True:
        # large star: every node points its larger neighbours to the smallest one it knows
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: every node points its smaller neighbours and itself to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where("u < v").distinct()
        small = cut(small)
        same = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() == stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        stars = small
        if same:
            break
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).union(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


MARK_WORDS = 1 << 20


def marked(rows: DataFrame, key: str, ids: DataFrame, name: str = "_marked") -> DataFrame:
    """``rows`` with a boolean that is true wherever ``key`` is in the only column of ``ids``.

    It may be true for a few others too: the ids become a bitmap of at most ``MARK_WORDS``
    words of 64 bits, a table with that bound on its rows, which is broadcast. It serves to
    keep most rows, with their texts, out of a shuffle; an exact join has to follow.
    """
    h = F.xxhash64(F.col(ids.columns[0]))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    words = ids.select(F.pmod(F.shiftright(h, 6), F.lit(MARK_WORDS)).alias("_mark_word"), mask.alias("_mark_bits")).groupBy("_mark_word").agg(F.bit_or("_mark_bits").alias("_mark_bits"))
    own = F.xxhash64(F.col(key))
    bit = F.call_function("shiftright", F.col("_mark_bits"), F.pmod(own, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return (
        rows.withColumn("_mark_word", F.pmod(F.shiftright(own, 6), F.lit(MARK_WORDS)))
        .join(F.broadcast(words), "_mark_word", "left")
        .withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_mark_word", "_mark_bits")
    )
