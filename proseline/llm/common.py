"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and characters of one slice that a Python worker turns into objects at once.
SLICE_ROWS = 512
SLICE_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master, whose tasks run on the driver's machine, gets a
    temporary one where neither is set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="proseline-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df, written as a table in the shared folder and read again, and the table's path."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df through a table in the shared folder: cuts lineage, survives lost executors. The table stays there, as results read it."""
    return written(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python objects of a slice stay small, however long the texts are."""
    for batch in batches:
        at, n = 0, batch.num_rows
        column = batch.column(text)
        while at < n:
            end, chars = at, 0
            while end < n and end - at < SLICE_ROWS and (end == at or chars < SLICE_CHARS):
                value = column[end]
                chars += len(value.as_buffer()) if value.is_valid else 0
                end += 1
            yield batch.slice(at, end - at)
            at = end


def map_texts(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Run make()(values of columns[1]) slice by slice; the first column passes through as it is.

    The returned dict has one list for each further column of schema, in order.
    """

    def run(batches):
        work = None
        for part in slices(batches):
            if work is None:
                work = make()
            out = work(part.column(1).to_pylist())
            arrays = [part.column(0), *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[columns[0], *out])

    return df.select(*columns).mapInArrow(run, schema)


def smallest(df: DataFrame, group: str, key: str, most: int, salt: int) -> Column:
    """A condition on rows of df: their key's hash is among the `most` smallest of their group; null groups never are.

    The choice is exact at every size: a share of the hashes that holds the
    smallest ones is taken first, then ranked. Rows that repeat a key go
    together. What comes to the driver is two numbers for each group.
    """
    h = F.xxhash64(F.col(key), F.lit(salt))
    sizes = {r[group]: r["count"] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not sizes:
        return F.lit(False)
    by_group = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col(group)]
    bounds = {k: min((1 << 63) - 1, (1 << 64) * (2 * most + 60) // n - (1 << 63)) for k, n in sizes.items()}
    few = df.select(group, h.alias("h")).where(F.col("h") <= by_group(bounds))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("h")))
    last = {r[group]: r["last"] for r in ranked.where(F.col("rank") <= most).groupBy(group).agg(F.max("h").alias("last")).collect()}
    return F.coalesce(h <= by_group(last), F.lit(False)) if last else F.lit(False)


#: Keys with the most rows that hot_join takes out of the shuffle by key.
HOT_KEYS = 1000


def hot_join(big: DataFrame, small: DataFrame, on: str, salt: str, times: str | None = None) -> DataFrame:
    """big with the fields of small, null where it has none; small has one row for each key.

    No key's rows meet in one task, however many it has: the HOT_KEYS
    commonest keys are looked up in a broadcast of HOT_KEYS rows at most, and
    their rows are dealt by the column `salt` in the sorted join that serves
    the others. Null keys match nothing. `times` names the column of small
    that says how many rows of big a key has; without it they are counted.
    """
    fields = [c for c in small.columns if c != on]
    if times is None:
        counted = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
        near = small.join(F.broadcast(counted.orderBy(F.desc("_n"), on).limit(HOT_KEYS).select(on)), on)
    else:
        near = small.orderBy(F.desc(times), on).limit(HOT_KEYS)
    near = near.select(F.col(on).alias("_hot"), F.struct(*fields).alias("_near"))
    rows = big.join(F.broadcast(near), F.col(on) == F.col("_hot"), "left")
    done = F.col("_hot").isNotNull() | F.col(on).isNull()
    rows = rows.withColumn("_cold", F.when(~done, F.col(on))).withColumn("_deal", F.when(done, F.xxhash64(salt)).otherwise(F.lit(0).cast("long")))
    zero = F.pmod(F.xxhash64(on), F.lit(1).cast("long"))  # no literal: the join would drop it from what rows are dealt by
    far = small.select(F.col(on).alias("_key"), zero.alias("_zero"), F.struct(*fields).alias("_far"))
    joined = rows.join(far.hint("merge"), (F.col("_cold") == F.col("_key")) & (F.col("_deal") == F.col("_zero")), "left").withColumn("_found", F.coalesce("_near", "_far"))
    return joined.select(*big.columns, *(F.col(f"_found.{c}").alias(c) for c in fields))


def connected_components(edges: DataFrame, tag: str = "cc", most_rounds: int = 1000) -> DataFrame:
    """Smallest reachable id for every id of edges(a, b): rows (id, component_id), both long.

    Alternating large-star and small-star rounds until nothing changes, each
    written to a table in the shared folder that goes when the next one is
    there. Minima are combined before the shuffle and a vertex with very many
    edges is dealt to many tasks, so it is no long list anywhere. Self-loops,
    repeated edges and edges with a null end are harmless. Rounds grow with
    the logarithm of the longest path; after most_rounds without an end it is
    an error, never a wrong result.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("a is not null and b is not null and v <> m").distinct(), tag)
    state = None
    for turn in range(most_rounds + 1):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            break
        if turn == most_rounds:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
        state = found
        # large star: every larger neighbour of v goes to v's smallest neighbour
        both = now.select("v", "m").union(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"), F.count(F.lit(1)).alias("n"))
        large = hot_join(both, least, "v", "m", "n").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        large = large.where("v <> m").distinct()
        # small star: v's smaller neighbours and v itself go to the smallest
        least = large.groupBy("v").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("n"))
        joined = hot_join(large, least, "v", "m", "n")
        small = joined.select(F.col("m").alias("v"), F.col("least").alias("m")).union(least.select("v", F.col("least").alias("m")))
        before = path
        now, path = written(small.where("v <> m").distinct(), tag)
        remove(spark, before)
    roots = now.groupBy("v").agg(F.min("m").alias("m"))
    return roots.select(F.col("v").alias("id"), F.col("m").alias("component_id")).union(
        now.select("m").distinct().join(roots.select("v"), F.col("m") == F.col("v"), "left_anti").select(F.col("m").alias("id"), F.col("m").alias("component_id"))
    )


def local_worker_env() -> None:
    """One thread for each Python worker; Spark runs as many workers as cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
