"""Embedding near-duplicates: an exact metric range join.

Cosine >= t on unit vectors is a distance of at most r = sqrt(2 - 2t). Each
label has pivots; a vector's home is the cell of its nearest pivot. If x has
its home at p and y is within r of x, then d(y, p) <= d(y, y's pivot) + 2r, by
the triangle inequality; so y is copied to every cell for which that holds,
and all of x's partners are in x's cell. Cells join independently; the homes
of a large cell are cut into blocks, each compared with the whole cell.

Equal vectors of a label are one class with a count. Links are counted where
a class is at home; of the links a cell passes on only a spanning set.

Defined results: null labels and vectors that are null, empty, zero, or hold
null or non-finite components link with nothing: no link, their own component.
Vectors of different length never link. Rows that repeat a vec_id count as
vectors of their own. A row without a vec_id links with nothing, has no
component and is kept. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import connected_components, hot_join, stored, table
from proseline.llm.op10_near_dups import sorted_runs

#: Vectors that a cell should have, home vectors of a block, pivots of all labels at most (but one for each), and of a cell in the second level.
CELL, BLOCK, MOST_PIVOTS, LATER_PIVOTS = 2000, 2000, 4096, 32


def normalised(df: DataFrame) -> DataFrame:
    """(vec_id, part, digest, unit): part is label and length; the last three are null where nothing may link."""

    def run(batches):
        for batch in batches:
            part, digest, unit = [], [], []
            for key, label, vector in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = None
                if key.is_valid and label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                    raw = vector.values.to_numpy(zero_copy_only=False)
                    x = raw.astype(np.float64)
                    norm = math.sqrt(x @ x) if np.all(np.isfinite(x)) else 0.0
                    if norm > 0 and not np.isfinite(norm):
                        x = x / np.abs(x).max()
                        norm = math.sqrt(x @ x)
                    elif not norm and np.all(np.isfinite(x)) and np.any(x):
                        x = x / np.abs(x).max()
                        norm = math.sqrt(x @ x)
                    x = x / norm if norm else None
                part.append(None if x is None else f"{label}:{len(x)}")
                digest.append(None if x is None else xxhash.xxh3_128_digest(part[-1].encode() + b"|" + raw.tobytes()))
                unit.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.string()), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "part", "digest", "unit"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, "vec_id long, part string, digest binary, unit binary")


def part_sizes(rows: DataFrame) -> dict[str, int]:
    """Home vectors of each part. Parts are labels, or cells of a level, of which there are MOST_PIVOTS and one for each label at most."""
    return {r["part"]: r["count"] for r in rows.where("home").groupBy("part").count().collect()}


def choose_pivots(rows: DataFrame, want: dict[str, int], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Pivots of each part, its home vectors with the smallest hashes. What comes to the driver is about three times the pivots."""
    if not want:
        return {}
    spark = rows.sparkSession
    top = 1 << 62
    shares = spark.createDataFrame([(p, min(top, top * (3 * want[p] + 20) // sizes[p])) for p in want], "part string, share long")
    homes = rows.where("home").join(F.broadcast(shares), "part").withColumn("h", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(top)))
    sample: dict[str, list] = {}
    for r in homes.where("h < share").select("part", "h", "id", "unit").collect():
        sample.setdefault(r["part"], []).append((r["h"], r["id"], r["unit"]))
    if len(sample) < len(want):  # the sample missed small parts: their first vectors by hash
        missed = homes.where(~F.col("part").isin(list(sample))).groupBy("part").agg(F.min(F.struct("h", "id", "unit")).alias("x"))
        sample |= {r["part"]: [(r["x"]["h"], r["x"]["id"], r["x"]["unit"])] for r in missed.collect()}
    return {p: np.array([np.frombuffer(u, np.float64) for _, _, u in sorted(found)[: want[p]]]) for p, found in sample.items()}


def cell_rows(rows: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """(part, cell, home, id, n, unit): every row of a part with pivots in its home and in the cells that the bound says; home if it was at home in the part."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                parts = np.array(rows.column(0).to_pylist(), object)
                units = rows.column(3).to_pylist()
                own = np.array(rows.column(4).to_pylist(), bool)
                for p in dict.fromkeys(parts.tolist()):
                    if p not in shared.value:
                        continue
                    spots = np.nonzero(parts == p)[0]
                    x = np.array([np.frombuffer(units[i], np.float64) for i in spots])
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ shared.value[p].T)))
                    home = d.argmin(axis=1)
                    i, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * radius + 1e-9)
                    took = rows.take(pa.array(spots[i]))
                    yield pa.RecordBatch.from_arrays([took.column(0), pa.array(cell.astype(np.int32)), pa.array((home[i] == cell) & own[spots[i]]), *took.columns[1:4]], names=["part", "cell", "home", "id", "n", "unit"])

    return rows.select("part", "id", "n", "unit", "home").mapInArrow(run, "part string, cell int, home boolean, id long, n long, unit binary")


def all_cells(classes: DataFrame, radius: float) -> DataFrame:
    """(part, cell, home, id, n, unit) of all classes. The cells of a label that MOST_PIVOTS gave too few pivots have cells in turn."""
    rows = classes.select("part", "id", "n", "unit", F.lit(True).alias("home"))
    sizes = part_sizes(rows)
    total = sum(sizes.values())
    need = {p: -(-n // CELL) for p, n in sizes.items()}
    want = {p: max(1, min(need[p], MOST_PIVOTS * n // max(1, total))) for p, n in sizes.items()}
    cells = cell_rows(rows, choose_pivots(rows, want, sizes), radius)
    few = [p for p in want if want[p] < need[p]]
    if not few:
        return cells
    cells = stored(cells, "vector-cells")
    rows = cells.where(F.col("part").isin(few)).select(F.concat_ws("/", "part", "cell").alias("part"), "id", "n", "unit", "home")
    sizes = part_sizes(rows)
    want = {p: min(-(-n // CELL), LATER_PIVOTS) for p, n in sizes.items()}
    return cells.where(~F.col("part").isin(few)).union(cell_rows(rows, choose_pivots(rows, want, sizes), radius))


def join_cells(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links, root): links of each class at home, and a spanning set of edges id - root."""
    sizes = rows.groupBy("part", "cell").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / F.lit(BLOCK))).cast("int").alias("blocks"))
    units = rows.join(sizes, ["part", "cell"]).withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")))
    units = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(F.xxhash64("part", "cell", "block").alias("u"), F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("here"), "id", "n", "unit")

    def run(batches):
        for rows in sorted_runs(batches):
            here = np.array(rows.column("here").to_pylist())
            ids, counts = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
            labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            homes = np.nonzero(here)[0]
            for at in range(0, len(homes), 256):
                some = homes[at : at + 256]
                linked = x[some] @ x.T >= threshold
                linked[np.arange(len(some)), some] = True
                links[some] = linked @ counts - 1
                for i in np.nonzero(linked.sum(axis=1) > 1)[0]:
                    found = np.unique(labels[linked[i]])
                    if len(found) > 1:
                        labels[np.isin(labels, found)] = found[0]
            keep = here | (labels != np.arange(len(ids)))
            links = pa.array(links[keep], pa.int64(), mask=~here[keep])
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), links, pa.array(ids[labels[keep]])], names=["id", "n_links", "root"])

    return units.repartition("u").sortWithinPartitions("u").mapInArrow(run, "id long, n_links long, root long")


def near_vectors(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df(vec_id, embedding, label)."""
    rows = stored(normalised(df), "vectors")
    classes = rows.where("digest is not null").groupBy("part", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    classes = stored(classes, "vector-classes")
    cells = all_cells(classes, math.sqrt(max(0.0, 2 - 2 * threshold)))
    joined = stored(join_cells(cells, threshold), "vector-links")
    links = joined.where("n_links is not null").groupBy("id").agg(F.max("n_links").alias("n_links"))
    found = connected_components(joined.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-cc")
    of_class = classes.select("digest", "id").join(links, "id").join(found, "id", "left").select("digest", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = hot_join(rows.select("vec_id", "digest"), of_class, "digest", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings within equal labels, cosine 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
