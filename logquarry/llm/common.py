"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Stands for a null doc_id inside an operator; sorts before every other id.
NULL_ID = -(2**63)
#: Distinct edges of a graph that one task settles at most (16 bytes each); larger graphs are never brought together.
IN_ONE_TASK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share; a temporary one only on a single machine whose session names none (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="logquarry-checkpoints-")
        sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again: compressed, with sizes the planner can see.

    A lazy result may read the folder until the application ends; then the file system removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column="text"):
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def doc_key(column="doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def from_doc_key(column):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def with_row_numbers(df: DataFrame, order_cols: list[str], name: str = "row_number") -> DataFrame:
    """Gapless global numbers from 0 in the order of the columns.

    A range exchange orders the rows, the checkpoint fixes them, and the counts of the range
    partitions (one number each) give the offsets, so no task ever sees more than its own range.
    Rows equal in all columns are told apart by an arbitrary id, so a repeated key is split too.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    ranged = cut(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, F.col("__tie"))
        .sortWithinPartitions(*order, F.col("__tie"))
        .drop("__tie")
    )
    counts = dict(ranged.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, total = [0], 0
    for p in range(max(counts, default=0) + 1):
        total += counts.get(p, 0)
        offsets.append(total)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, place + F.element_at(F.lit(offsets), F.spark_partition_id() + 1))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) longs: (node, root), root the smallest node reachable.

    Up to IN_ONE_TASK distinct edges (a bound on one task's memory, checked by a count) are settled in one task;
    more by `star_components`. Both give the same rows. Nodes without an edge to another node are not returned.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = written(pairs.distinct())
    return one_task_components(pairs) if pairs.count() <= IN_ONE_TASK else star_components(pairs)


def one_task_components(pairs: DataFrame) -> DataFrame:
    """components() of few distinct pairs (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ends = [np.concatenate([b.column(j).to_numpy() for b in parts]) for j in range(2)]
        nodes, index = np.unique(np.concatenate(ends), return_inverse=True)
        index = index.reshape(2, -1)
        label = min_labels(len(nodes), index[0], index[1])
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[label[i : i + (1 << 16)]])], ["node", "root"])

    ship_package(pairs.sparkSession)
    return pairs.coalesce(1).mapInArrow(run, "node long, root long")


def star_components(pairs: DataFrame) -> DataFrame:
    """components() of any number of distinct pairs (u, v), u > v.

    Alternating large-star and small-star steps: every step is a minimum per node (combined on the map
    side) and an equi-join back. The minima are checkpointed before the join, so that both of its sides
    arrive by a plain exchange and the adaptive skew join can split a node with very many neighbours.
    """
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.bit_xor(mark), F.lit(0)), F.sum(F.shiftright(mark, 20))).first())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def min_labels(n: int, left: np.ndarray, right: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Components of a small in-memory graph on 0..n-1: each node's smallest reachable number."""
    label = np.arange(n) if start is None else start
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
