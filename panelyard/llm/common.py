"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once: bounds a worker's memory.
TEXT_BATCH = 256

_cleared: set[str] = set()
_models: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset in local mode (tests) a temporary folder is made and set. On a
    cluster a folder of one machine would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelyard-")
        spark.conf.set("spark.checkpoint.dir", found)
    # Spark writes a path without a scheme to the cluster's default store; what else reads it must look there too.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    return at.toUri().toString().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this Python process ends."""
    path = f"{shared_dir(spark)}/panelyard-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def clear() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass

    if path not in _cleared:
        _cleared.add(path)
        atexit.register(clear)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The lineage ends at files every executor can read, so a lost executor costs
    only its running tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = TEXT_BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that texts become Python objects a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over small slices: ``fn`` takes a RecordBatch and returns column lists or arrays."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = fn()
        for batch in text_batches(batches):
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a fitted model; the function returned gives it back in a task.

    A Python worker keeps the model of its last task, so a model is read once a
    worker rather than once a task.
    """
    held, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: _model(key, held)


def _model(key: str, held):
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(held.value)
    return _models[key]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names: so other columns may stand beside them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, those that hold maps by their JSON."""
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    held = [F.to_json(F.struct(F.col(c))) if "map<" in kind else F.col(c) for c, (_, kind) in zip(names, df.dtypes, strict=True)]
    return F.xxhash64(*held)


def id_crc32(column: str = "doc_id") -> Column:
    """CRC-32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def spread_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of ``key``; all rows where there are fewer.

    Only for fitting classifiers; the bound is a documented parameter of each caller.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * 2**31)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(2**31)) < share)


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an edge list.

    ``edges`` has ``src`` and ``dst`` of one orderable type. Returns ``node`` and
    ``component``, one row for each node that an edge names. Alternates the two
    star contractions (larger neighbours, then smaller ones, are hung on the
    smallest neighbour); each halves the depth, so the rounds grow with the
    logarithm of the longest chain. Each round is one aggregation and one join,
    written to the shared folder. A hub's rows are only ever pre-aggregated
    minima, and the join's edge side may be split by AQE.
    """
    work = cut(edges.select("src", "dst").where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name)
    before = None
    for _ in range(most_rounds):
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        work = cut(hung.where("u <> v").distinct(), name)
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).union(work.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
