"""Whitening of embeddings by a tiled covariance.

Tasks cut their rows into row blocks, and each row block into column blocks. The column blocks are shuffled by row block; where
those of one row block meet, each pair of them is multiplied (a tile key is a pair of column blocks), and products are added up
per tile, in the task first, then over a few salts, then per tile. The tiles make the covariance, whose size depends on the number of
dimensions and not of rows; its eigenvectors are found on the driver and go back to the rows.

Entries become integers, x = floor(64 * c) + 1000000, so counts, sums and deviations are exact; what is multiplied is centred
before, as (n * x - S) / n. The covariance of the whitened rows is measured by the same tiles.

Defined results: a vector that is null, empty or holds a null or an entry that isn't finite has no rows. Vectors of another length than
the commonest (of equals the greater) have no place in the covariance and have no rows. A null id is kept; equal rows count
each. Components whose eigenvalue is zero up to rounding have no direction and no rows, so equal vectors alone give none. Entries
beyond +-2**62 / 64 count as that; a deviation beyond a long is null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepath.llm.common import read_table

SCALE, SHIFT, MOST = 64.0, 1_000_000, float(1 << 62)
TILE = 128  # dimensions of a column block
BLOCK_BYTES = 8 << 20  # of a row block, as doubles
TILE_BYTES = 64 << 20  # of the products that a task holds before it hands them on
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that count."""
    v = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("v").isNotNull() & ~odd & (F.size("v") > 0))
    lengths = v.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return v.where(F.size("v") == (lengths[0]["length"] if lengths else 0))


def whole_numbers(v: pa.Array) -> np.ndarray:
    """x - SHIFT of each entry, a row for each vector."""
    if not len(v):
        return np.empty((0, 0), np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64).reshape(len(v), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of x - SHIFT in each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            y = whole_numbers(batch.column(0))
            if len(y):
                safe = int(np.abs(y).max()) < (1 << 62) // len(y)
                add = (y if safe else y.astype(object)).sum(axis=0).astype(object)
                n, total = n + len(y), add if total is None else total + add
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total)))], ["d", "n", "s"])

    found = rows.select("v").mapInArrow(part, "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = sorted(found.collect())  # a row for each dimension
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def differences(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they are enough, else Python's integers."""
    most = max(int(np.abs(y).max()) * n, max(map(abs, s))) if len(y) else 0
    return y * n - np.array(s, np.int64) if most < 1 << 61 else y.astype(object) * n - np.array(s, object)


def deviations(d: np.ndarray) -> list[int | None]:
    most = float(np.abs(d).max()) if d.size else 0.0
    if d.dtype != object and most * most * d.shape[1] < MOST:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(x * x for x in row) for row in d.astype(object).tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def smallest(block: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them."""
    if block.dtype.kind != "i":
        return block
    least, most = int(block.min()), int(block.max())
    return block.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


TILES = "i int, j int, salt int, product binary"


def _add_up(tiles: DataFrame, *keys: str) -> DataFrame:
    """One row for each key and task at most; products of a key stream past one running sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, salt, product in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and (i, j, salt)[: len(keys)] != key[: len(keys)]:
                    yield _tiles([(*key, total)])
                    key = None
                new = np.frombuffer(product)
                key, total = ((i, j, salt), new.copy()) if key is None else (key, total + new)
        if key is not None:
            yield _tiles([(*key, total)])

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, TILES)


def _tiles(rows: list[tuple]) -> pa.RecordBatch:
    i, j, salt, product = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(salt, pa.int32()), pa.array([p.tobytes() for p in product], pa.binary())], ["i", "j", "salt", "product"])


def tiled_products(rows: DataFrame, values: Callable[[pa.Array], np.ndarray], centre: Callable[[np.ndarray, slice], np.ndarray], dims: int, tile: int = TILE) -> np.ndarray:
    """The sum over all rows of v v', where v is what ``values`` makes of a row's vector and ``centre`` of a column block."""
    height = max(1, BLOCK_BYTES // (8 * dims))
    cuts = [slice(at, min(at + tile, dims)) for at in range(0, dims, tile)]

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, height):
                m = values(batch.column(0).slice(at, height))
                blocks = [smallest(np.ascontiguousarray(m[:, c])) for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([b.dtype.str for b in blocks]), pa.array([b.tobytes() for b in blocks], pa.binary())],
                    ["row_block", "column_block", "kind", "data"],
                )
                made += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % 16
        sums: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        now, blocks = None, []
        for batch in batches:
            for row_block, k, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if row_block != now:
                    now, blocks = row_block, []
                block = centre(np.frombuffer(data, np.dtype(kind)).reshape(-1, cuts[k].stop - cuts[k].start), cuts[k])
                blocks.append(block)
                for i, left in enumerate(blocks):  # the pairs that this block completes
                    product = (left.T @ block).ravel()
                    if (i, k) in sums:
                        sums[i, k] += product
                    else:
                        sums[i, k] = product
                        held += product.nbytes
                if held > TILE_BYTES:
                    yield _tiles([(i, j, salt, p) for (i, j), p in sums.items()])
                    sums, held = {}, 0
        if sums:
            yield _tiles([(i, j, salt, p) for (i, j), p in sums.items()])

    blocks = rows.select("v").mapInArrow(cut_blocks, "row_block long, column_block int, kind string, data binary")
    blocks = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    products = _add_up(_add_up(blocks.mapInArrow(multiply, TILES), "i", "j", "salt"), "i", "j")
    out = np.zeros((dims, dims))
    for i, j, _, product in products.collect():  # as many bytes as the covariance has
        block = np.frombuffer(product).reshape(cuts[i].stop - cuts[i].start, -1)
        out[cuts[i], cuts[j]] = block
        out[cuts[j], cuts[i]] = block.T
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are above rounding, falling, and their unit vectors as columns."""
    e, vectors = np.linalg.eigh(covariance)
    e, vectors = e[::-1][:most], vectors[:, ::-1][:, :most]
    there = e > np.trace(covariance) * len(covariance) * 1e-15
    return e[there], vectors[:, there]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, tile: int = TILE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row that counts."""
    rows = fit_rows(table, id_col, vector_col)
    n, s = sums(rows)
    dims = len(s)
    nothing = table.sparkSession.createDataFrame([], WHITENED)
    if not n:
        return nothing

    def centred(y: np.ndarray, at: slice) -> np.ndarray:
        return differences(y.astype(np.int64), n, s[at]).astype(float) / n

    covariance = tiled_products(rows, whole_numbers, centred, dims, tile) / n
    e, vectors = components(covariance, most)
    k = len(e)
    if not k:
        return nothing
    turn = vectors / np.sqrt(e)
    explained = (e / np.trace(covariance)).tolist()

    def with_one(v: pa.Array) -> np.ndarray:
        w = centred(whole_numbers(v), slice(None)) @ turn
        return np.column_stack([w, np.ones(len(w))])

    second = tiled_products(rows, with_one, lambda block, _: block, k + 1, tile) / n  # the last column has the means
    error = float(np.abs(second[:k, :k] - np.outer(second[:k, k], second[:k, k]) - np.eye(k)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                d = differences(whole_numbers(some.column(1)), n, s)
                which = pa.array(np.repeat(np.arange(len(d)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), pa.array(np.full(len(d) * k, n)), pa.array(deviations(d), pa.int64()).take(which),
                        pa.array((d.astype(float) / n @ turn).ravel()), pa.array(np.tile(explained, len(d))), pa.array(np.full(len(d) * k, error)),
                    ],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(out, WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
