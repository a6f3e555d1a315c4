"""Exact vector retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.sources.shared import stash

#: Vectors of a block, queries that meet it in one matrix product, and pairs that are scored one by one at a time.
BLOCK, QUERIES, PAIRS = 2048, 256, 50_000
#: Bytes of queries, and of vectors, of a cell.
HELD = 64 << 20
#: More than a product of unit vectors is off by rounding.
ROUNDING = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def topk(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The k nearest of all vectors by cosine; filter ``vectors`` before, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k nearest of all vectors for every query, exactly; ties by id.

    Both sides are packed into blocks, which are dealt over a grid of cells: queries by its columns, vectors by its rows. A cell holds its
    queries (HELD bytes) with k candidates of each, and meets its vectors block by block; candidates of a query are ranked at the end. Nothing passes through the driver or is broadcast. Null vectors are
    left out on both sides; vectors whose length differs from a query's have no score with it; a zero vector scores 0, one that holds NaN comes first. Equal vectors score the same.
    """
    id_type = dict(vectors.dtypes)[id_col]
    single = all(dict(f.dtypes)[col] == "array<float>" for f in (queries, vectors))
    number, kind = (np.float32, "float") if single else (np.float64, "double")

    def blocks(frame: DataFrame) -> DataFrame:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, lists = batch.columns
                sizes = pa.compute.list_value_length(lists).to_numpy()
                values, starts = lists.flatten().fill_null(0).to_numpy(), np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    for i in range(0, len(own), BLOCK):
                        at = own[i : i + BLOCK]
                        data = values[(starts[at][:, None] + np.arange(dim)).ravel()]
                        yield pa.RecordBatch.from_pydict({"ids": pa.array([names.take(pa.array(at)).to_pylist()], pa.list_(names.type)), "dim": pa.array([dim], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

        return frame.where(F.col(col).isNotNull()).select(id_col, F.col(col).cast(f"array<{kind}>")).mapInArrow(packed, f"ids array<{id_type}>, dim int, data binary")

    wanted = stash(blocks(queries), "knn-queries")
    asked, held = wanted.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    tasks, n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), vectors.count()
    # What is shuffled is least where both sides are about equal: vectors go to all columns, queries to all rows.
    columns = max(1, -(-held // HELD), round(math.sqrt(tasks * asked / max(n, 1))))
    rows = max(1, min(-(-tasks // columns), -(-n // BLOCK)), math.ceil(n * held / max(asked, 1) / HELD))

    def dealt(frame: DataFrame, mine: int, others: int, vector: bool) -> DataFrame:
        own, other = F.pmod(F.xxhash64("ids"), F.lit(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        placed = frame.withColumn("_own", own).withColumn("_other", other)
        cell = F.col("_own") * columns + F.col("_other") if vector else F.col("_other") * columns + F.col("_own")
        return placed.select(cell.alias("cell"), F.lit(vector).alias("vector"), "ids", "dim", "data")

    sent = dealt(wanted, columns, rows, False).unionByName(dealt(blocks(vectors), rows, columns, True))

    def unit(data: bytes, dim: int, size: int) -> np.ndarray:
        v = np.frombuffer(data, number).astype(np.float64).reshape(size, dim)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n != 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None

        def blocks_of() -> Iterator[tuple]:
            nonlocal id_kind
            for batch in batches:
                id_kind = batch.column(2).type.value_type
                for i in range(batch.num_rows):
                    yield tuple(batch.column(j)[i].as_py() for j in range(5))

        for _, members in groupby(blocks_of(), key=itemgetter(0)):
            # Of each length: names, unit vectors, and the best keys and ids so far of QUERIES queries at a time.
            found: dict[int, list[list]] = {}
            for _, vector, ids, dim, data in members:
                v, ids = unit(data, dim, len(ids)), np.array(ids)
                if not vector:
                    for i in range(0, len(ids), QUERIES):
                        found.setdefault(dim, []).append([ids[i : i + QUERIES], v[i : i + QUERIES], None])
                    continue
                for own in found.get(dim, ()):
                    own[2] = best_of(own[1], own[2], v, ids, k)
            for names, _, best in (own for some in found.values() for own in some):
                if best is not None:
                    keys, ids = best
                    got = keys > -np.inf
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(names, got.sum(axis=1)).tolist(), id_kind), id_col: pa.array(ids[got].tolist(), id_kind), "score": np.where(keys[got] == np.inf, np.nan, keys[got])})

    cells = sent.repartition(columns * rows, "cell").sortWithinPartitions("cell", "vector")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return cells.mapInArrow(nearest, f"query_id {id_type}, {id_col} {id_type}, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(queries: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (NaN as infinity, none as -infinity) and ids of the k best for each of some unit ``queries``: of the ``best`` so far and these unit ``vectors``.

    The matrix product proposes, within its rounding; what it proposes is scored pair by pair, so equal vectors have equal scores wherever they stand.
    """
    n = len(queries)
    best = best or (np.full((n, k), -np.inf), np.repeat(ids[:1], n * k).reshape(n, k))
    near = queries @ vectors.T
    near[np.isnan(near)] = np.inf
    floor = best[0][:, -1]
    if near.shape[1] > k and not np.isfinite(floor).all():
        floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
    row, at = np.nonzero(near >= floor[:, None] - ROUNDING)
    del near
    if not len(row):
        return best
    exact = np.concatenate([(queries[row[i : i + PAIRS]] * vectors[at[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(row), PAIRS)])
    exact[np.isnan(exact)] = np.inf
    rows, keys, names = np.concatenate([np.repeat(np.arange(n), k), row]), np.concatenate([best[0].ravel(), exact]), np.concatenate([best[1].ravel(), ids[at]])
    order = np.lexsort((names, -keys, rows))
    take = order[np.searchsorted(rows[order], np.arange(n))[:, None] + np.arange(k)]
    return keys[take], names[take]


def store(vectors: DataFrame, path: str, model: str, dim: int, col: str = "embedding") -> None:
    """Replaces one model's partition of a vector store; a vector of another length is refused."""
    checked = vectors.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(F.raise_error(F.lit(f"a vector is not of length {dim}"))))
    checked.withColumns({"dim": F.lit(dim), "model": F.lit(model)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
