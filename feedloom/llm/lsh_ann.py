"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

Unit vectors are projected on Gaussian directions and cut into cells, so that
Euclidean closeness, and with it cosine, decides about common buckets. A query
visits the buckets around its own in the order of estimated success (Lv et al.
2007): perturbations with the least squared distance to the cell walls first.
Every vector is indexed. Defaults were chosen on uniform directions in 64
dimensions, where neighbours are hardest to find: recall of the five nearest is
0.98 there, at the price of visiting more than half of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import mix

TABLES = 6
HASHES = 8  # projections of a table
WIDTH = 2.0  # of a cell; projections of unit vectors have deviation 1
PROBES = 192  # buckets that a query visits in each table
BLOCK = 4096  # indexed vectors that a task holds at a time
ROUNDING = 1e-12  # matrix products are closer than this to the cosines
PAIRS = 1 << 14  # cosines computed in one step
ROWS = "bucket long, id long, vector binary"

STEPS = np.array(list(product((0, 1, 2), repeat=HASHES)))  # stay, down, up in each projection
CHOICE = np.zeros((3 * HASHES, len(STEPS)))
for _i in range(HASHES):
    CHOICE[3 * _i + STEPS[:, _i], np.arange(len(STEPS))] = 1


def directions(dims: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dims, table, 20240])
    return rng.normal(size=(dims, HASHES)), rng.uniform(0, WIDTH, HASHES)


def bucket_ids(cells: np.ndarray, table: int, dims: int) -> np.ndarray:
    key = np.full(cells.shape[:-1], (dims << 8) + table + 1, np.uint64)
    for i in range(cells.shape[-1]):
        key = mix(key ^ cells[..., i].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _units(vectors: list[bytes]) -> np.ndarray:
    x = _matrix(vectors)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def place(probe: bool):
    """Map ``id, vector`` to the buckets it is indexed in, or that it visits as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), batch.column("vector").to_pylist()
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                units, dims = _units([raw[i] for i in own]), int(size) // 8
                cells = pa.array([raw[i] for i in own], pa.binary())
                for table in range(TABLES):
                    a, b = directions(dims, table)
                    spots = (units @ a + b) / WIDTH
                    home = np.floor(spots)
                    if not probe:
                        yield _placed(bucket_ids(home, table, dims), ids[own], cells)
                        continue
                    inside = spots - home
                    cost = np.stack([np.zeros_like(inside), inside**2, (1 - inside) ** 2], 2).reshape(len(own), -1)
                    best = np.argpartition(cost @ CHOICE, PROBES - 1, axis=1)[:, :PROBES]
                    moved = home[:, None, :] + np.array([0, -1, 1])[STEPS[best]]
                    rows = np.repeat(np.arange(len(own)), PROBES)
                    yield _placed(bucket_ids(moved, table, dims).ravel(), ids[own][rows], cells.take(pa.array(rows)))

    return run


def _placed(buckets: np.ndarray, ids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids), vectors], names=["bucket", "id", "vector"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``, a function of these two rows alone.

    Sums are taken in extended precision and rounded to a double once, at the end, so
    multiples of a vector have equal cosines. Rows are scaled by powers of two, which
    changes no digit and keeps squares from overflowing.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]).astype(np.longdouble) for x in (a, b))
    return ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))).astype(np.float64)


def _likely(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all scores that may be among the k largest of their row."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    border = np.partition(scores, -k, axis=1)[:, -k] - 2 * ROUNDING
    return np.nonzero(scores >= border[:, None])


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best distinct candidates of each query."""
    query, found, score = rows
    order = np.lexsort((-score, found, query))
    query, found, score = query[order], found[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    query, found, score = query[new], found[new], score[new]
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], found[rank < k], score[rank < k]


def rerank(k: int, most: int = 500_000):
    """Exact cosines of the visitors of each bucket; the k best of every query are passed on.

    Rows come sorted by bucket, block and kind: the indexed vectors of a block,
    then its visitors. Memory holds one block and ``most`` candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base_ids, base_raw, base = None, [], [], None
        kept: list[tuple[np.ndarray, ...]] = []
        n_kept = 0
        for batch in batches:
            bucket, spot, kind, ids = (batch.column(c).to_numpy() for c in ("bucket", "spot", "kind", "id"))
            raw = batch.column("vector")
            change = np.ones(len(bucket), bool)
            change[1:] = (bucket[1:] != bucket[:-1]) | (spot[1:] != spot[:-1]) | (kind[1:] != kind[:-1])
            cuts = [*np.flatnonzero(change).tolist(), len(bucket)]
            for i, j in zip(cuts, cuts[1:]):
                if key != (bucket[i], spot[i]):
                    key, base_ids, base_raw, base = (bucket[i], spot[i]), [], [], None
                vectors = raw.slice(i, j - i).to_pylist()
                if kind[i] == 0:
                    base_ids.append(ids[i:j])
                    base_raw += vectors
                    continue
                if not base_raw:
                    continue
                if base is None:
                    held, base, whole = np.concatenate(base_ids), _units(base_raw), _matrix(base_raw)
                row, column = _likely(_units(vectors) @ base.T, k)
                asked = _matrix(vectors)
                for p in range(0, len(row), PAIRS):
                    r, c = row[p : p + PAIRS], column[p : p + PAIRS]
                    best = _best((ids[i:j][r], held[c], cosines(asked[r], whole[c])), k)
                    kept.append(best)
                    n_kept += len(best[0])
                if n_kept > most:
                    kept = [_best(tuple(map(np.concatenate, zip(*kept))), k)]
                    n_kept = len(kept[0][0])
                    if n_kept > most // 2:
                        yield _candidates(kept[0])
                        kept, n_kept = [], 0
        if kept:
            yield _candidates(_best(tuple(map(np.concatenate, zip(*kept))), k))

    return run


def _candidates(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["query", "found", "score"])


def _meet(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``query, found, score``: the best of every bucket block; crowded buckets are dealt into blocks."""
    crowded = index.groupBy("bucket").count().where(F.col("count") > BLOCK)
    crowded = crowded.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    spot = F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).cast("int")
    indexed = index.join(crowded, "bucket", "left").select("bucket", spot.alias("spot"), F.lit(0).alias("kind"), "id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
    visiting = probes.join(crowded, "bucket", "left").select("bucket", every.alias("spot"), F.lit(1).alias("kind"), "id", "vector")
    return (
        indexed.unionByName(visiting)
        .repartition("bucket", "spot")
        .sortWithinPartitions("bucket", "spot", "kind")
        .mapInArrow(rerank(k), "query long, found long, score double")
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; rows that take no part are left out."""
    for batch in batches:
        ids, asks, raw = [], [], []
        for vec_id, ask, values in zip(*(batch.column(c) for c in ("vec_id", "asks", "embedding"))):
            if not values.is_valid or values.values.null_count or not len(values.values):
                continue
            x = values.values.to_numpy() + 0.0  # no negative zero
            if np.isfinite(x).all() and x.any():
                ids.append(vec_id.as_py())
                asks.append(ask.as_py())
                raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(asks, pa.bool_()), pa.array(raw, pa.binary())],
            names=["vec_id", "asks", "vector"],
        )


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each query by cosine, nearest first.

    ``vectors`` has ``vec_id`` and ``embedding`` (an array of numbers). A score is the
    cosine of the two original vectors in doubles, not rounded; ties go to the smaller
    vec_id. Equal vectors are indexed once and stand for their k + 1
    smallest ids, which is all that a list of k can show. A query that finds fewer
    than k is compared with all vectors, block by block.

    Nulls: rows with a null id, or whose vector is null, empty, zero or holds a
    null or non-finite component, take no part. Only vectors of equal length are
    compared. Of rows that share an id the one with the smallest bytes counts. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    encoded = stored(rows.mapInArrow(_encode, "vec_id long, asks boolean, vector binary"), "vectors")
    single = encoded.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    groups = stored(
        single.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("id"), F.collect_list("vec_id").alias("ids")),  # k + 1 at most
        "vector-groups",
    )
    asked = stored(
        single.where("asks").select(F.col("vec_id").alias("query_id"), "vector").join(groups, "vector").select("query_id", "id"),
        "asked",
    )
    index = stored(groups.select("id", "vector").mapInArrow(place(False), ROWS), "index")
    askers = groups.select("id", "vector").join(asked, "id", "left_semi")
    found = stored(_meet(index, askers.mapInArrow(place(True), ROWS), k + 1), "candidates")

    sizes = groups.select(F.col("id").alias("found"), F.size("ids").alias("size"))
    reached = found.select("query", "found").distinct().join(sizes, "found").groupBy("query").agg(F.sum("size").alias("n"))
    short = stored(
        askers.join(reached, F.col("id") == F.col("query"), "left").where(F.coalesce("n", F.lit(0)) <= k).select("id", "vector"), "short"
    )
    if short.limit(1).count():
        everywhere = F.length("vector").cast("long").alias("bucket")  # one bucket for each vector length
        scan = _meet(groups.select(everywhere, "id", "vector"), short.select(everywhere, "id", "vector"), k + 1)
        found = found.unionByName(stored(scan, "candidates"))

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "found")
    top = (
        found.groupBy("query", "found")
        .agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .join(groups.select(F.col("id").alias("found"), "ids"), "found")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.join(top, F.col("id") == F.col("query"))
        .select("query_id", F.explode("ids").alias("vec_id"), "score")
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
