"""Centroid clustering by columns: every task holds a block of dimensions, not whole vectors.

The vectors are cut into tiles (some thousand vectors, one column block each),
stored as a table bucketed by (tile, block).  A round has three steps:

1. a task takes the tiles of a block and that block's slice of the centroids and
   finds the exact squared distances over its columns;
2. the partial distances of a tile are added up over its blocks, and each vector
   goes to its nearest centroid;
3. the assignments, one number a vector, go back to the blocks, whose tasks add
   up their own columns for each cluster: the next slice of the centroids.

The tiles themselves are not shuffled: the join of step 3 meets them in their
buckets.  What moves in a round are distances and assignments.  All sums are of
integers, so neither the order of addition nor the number of tasks shows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zealmark.llm.common import partitions
from zealmark.session import discard, scratch_path, stage

# Vectors of a tile and columns of a block: a tile of one block is a few hundred KB at most.
TILE, BLOCK = 2048, 32
# Tiles that one Arrow batch carries to a Python worker
TILES_A_BATCH = 32
SCALE = 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

Centroids = list[list[int]]


@contextmanager
def _arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def whole_vectors(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): vectors of ``dims`` components, none null or non-finite, as integers floor(1024 * x)."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    narrow = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vec.alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # up to here a squared difference fits a long; sums are watched in the tasks
    far = F.exists("vec", lambda x: F.abs(x) >= float(1 << 20))
    kept = narrow.where(F.size("vec") == dims).where(F.coalesce(sound, F.lit(False)))
    whole = F.transform("vec", lambda x: F.floor(x * float(SCALE)))
    return kept.select("vec_id", F.when(far, F.raise_error(F.lit("a component of 2**20 or more has no squared distance in 64 bits"))).otherwise(whole).alias("vec"))


def _packed(values: np.ndarray) -> bytes:
    """Integers as 4 bytes each where they fit, else as 8."""
    small = not values.size or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
    return values.astype("<i4" if small else "<i8").tobytes()


def _unpacked(data: bytes, items: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * items else "<i8").astype(np.int64)


TILE_SCHEMA = "tile bigint, block int, size int, ids array<bigint>, data binary"


def _tiles(dims: int, tile: int, block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # deterministic: the n-th tile of this partition
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for low in range(0, len(ids), tile):
                part = matrix[low : low + tile]
                blocks = range(0, dims, block)
                rows = [(name, b, len(part), ids[low : low + tile] if b == 0 else None, _packed(np.ascontiguousarray(part[:, at : at + block]))) for b, at in enumerate(blocks)]
                name += 1
                yield _batch(rows, [("tile", pa.int64()), ("block", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])

    return cut


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _partial_distances(centroids: Centroids, block: int):
    """Step 1: the squared distances of a tile to the slices of its block, one row of the matrix for each centroid."""
    whole = np.array(centroids, dtype=np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, b, size, ids, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "block", "size", "ids", "data"))):
                slices = whole[:, b * block : (b + 1) * block]
                part = _unpacked(data, size * slices.shape[1]).reshape(size, -1)
                out = np.empty((len(slices), size), np.int64)
                for k, centre in enumerate(slices):
                    gap = part - centre
                    if size and float(np.abs(gap).max()) ** 2 * gap.shape[1] >= 2.0**62:
                        raise OverflowError("a squared distance does not fit 64 bits")
                    out[k] = np.einsum("ij,ij->i", gap, gap)
                rows.append((name, size, ids, _packed(out)))
            yield _batch(rows, [("tile", pa.int64()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])

    return measure


def _nearest(k: int):
    """Step 2: a tile's distances added over its blocks; each vector's nearest centroid, ties to the smaller number."""

    def add(batch: pa.Table) -> pa.Table:
        size = batch.column("size")[0].as_py()
        total = np.zeros((k, size), np.int64)
        for data in batch.column("data").to_pylist():
            part = _unpacked(data, k * size).reshape(k, size)
            if size and float(total.max()) + float(part.max()) >= 2.0**63:
                raise OverflowError("a squared distance does not fit 64 bits")
            total += part
        cluster = total.argmin(axis=0)
        ids = next((x for x in batch.column("ids").to_pylist() if x is not None), None)
        row = (batch.column("tile")[0].as_py(), ids, cluster.astype("<i4").tobytes(), np.take_along_axis(total, cluster[None, :], 0)[0].astype("<i8").tobytes())
        return pa.Table.from_batches([_batch([row], [("tile", pa.int64()), ("ids", pa.list_(pa.int64())), ("cluster", pa.binary()), ("distance", pa.binary())])])

    return add


def _assigned(tiles: DataFrame, centroids: Centroids, block: int, with_ids: bool) -> DataFrame:
    source = tiles if with_ids else tiles.withColumn("ids", F.lit(None).cast("array<bigint>"))
    partial = source.mapInArrow(_partial_distances(centroids, block), "tile bigint, size int, ids array<bigint>, data binary")
    return partial.groupBy("tile").applyInArrow(_nearest(len(centroids)), "tile bigint, ids array<bigint>, cluster binary, distance binary")


def _column_sums(dims: int, block: int):
    """Step 3: for each cluster and column of the task's tiles the sum and the number of vectors, once a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for b, size, data, cluster in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "data", "cluster"))):
                which = np.frombuffer(cluster, "<i4")
                part = _unpacked(data, size * min(block, dims - b * block)).reshape(size, -1)
                for c in np.unique(which).tolist():
                    mine = part[which == c]
                    sums[b, c] = sums.get((b, c), 0) + mine.sum(axis=0)
                    counts[b, c] = counts.get((b, c), 0) + len(mine)
        rows = [(c, b * block + j, int(v), counts[b, c]) for (b, c), total in sums.items() for j, v in enumerate(total)]
        yield _batch(rows, [("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    return add


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cluster, distance in zip(*(batch.column(c).to_pylist() for c in ("ids", "cluster", "distance"))):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(cluster, "<i4")), pa.array(np.frombuffer(distance, "<i8"))], names=["vec_id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``; equal ids go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(row.vec) for row in vectors.withColumn("key", key).orderBy("key", "vec").limit(k).collect()]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    seed: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Cluster and squared distance of every whole vector after ``rounds`` rounds.

    One row for each vector that has ``dims`` components, none null or
    non-finite: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.  Rows that repeat an id, or have none, are
    vectors of their own; with fewer than ``k`` vectors there are as many
    centroids as vectors; an empty table gives no rows.  Other columns are
    ignored.  A component of 2**20 or more, or a distance that does not fit 64 bits, is
    an error, as the result could not hold it.

    The driver holds the centroids: ``k`` times ``dims`` numbers.  Rounds end early
    where the centroids stay as they are, as all later rounds would.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dims, id_col, vec_col)
    centroids = first_centroids(whole, k, seed)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not centroids:
        done, shas, sums = spark.createDataFrame([], schema), {}, {}
        return _described(done, sums, shas)
    blocks = -(-dims // block)
    name, path = f"tiles_{uuid.uuid4().hex}", scratch_path(spark, "tiles")
    with _arrow_rows(spark, tile):
        cut = whole.mapInArrow(_tiles(dims, tile, block), TILE_SCHEMA)
        n = partitions(spark)
        cut.repartition(n, "block", "tile").write.format("parquet").bucketBy(n, "block", "tile").sortBy("block", "tile").option("path", path).saveAsTable(name)
    try:
        with _arrow_rows(spark, TILES_A_BATCH):
            tiles = spark.table(name)
            for _ in range(rounds):
                moved = _moved(tiles, centroids, blocks, block)
                if moved == centroids:
                    break
                centroids = moved
            last = _assigned(tiles, centroids, block, with_ids=True)
            done = stage(last.mapInArrow(_expand, schema), "clusters")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)
    sums = {row.cluster: row.total for row in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    shas = {c: hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for c, centre in enumerate(centroids)}
    return _described(done, sums, shas)


def _moved(tiles: DataFrame, centroids: Centroids, blocks: int, block: int) -> Centroids:
    """The centroids after one round; a cluster without vectors keeps its centroid."""
    where = _assigned(tiles, centroids, block, with_ids=False).select("tile", "cluster", F.explode(F.array(*[F.lit(b) for b in range(blocks)])).alias("block"))
    met = tiles.select("block", "tile", "size", "data").join(where, ["block", "tile"])
    parts = met.mapInArrow(_column_sums(len(centroids[0]), block), "cluster int, dim int, total bigint, n bigint")
    # one row for each cluster and column
    exact = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    moved = [list(centre) for centre in centroids]
    for row in exact:
        moved[row.cluster][row.dim] = int(row.total) // row.n
    return moved


def _described(done: DataFrame, sums: dict[int, int], shas: dict[int, str]) -> DataFrame:
    spark = done.sparkSession
    rows = [(c, total, sum(sums.values()), shas[c]) for c, total in sums.items()]
    # one row for each cluster
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
