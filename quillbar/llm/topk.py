"""Exact top-k inner products by norm buckets.

Vectors become whole numbers, ``floor(scale * x)``, so scores are exact and ties are real. Candidates are grouped into buckets of similar length, the longest
first. A query needs only what can reach its threshold, the k-th best score it has so far:

* a bucket whose longest vector times the query's length is below the threshold is skipped;
* the threshold over the lengths is the cosine that a vector of the bucket must have. While this local threshold is low, the bucket is cut by length: vectors shorter than
  threshold / query length are left out. From ``BY_COORDINATE`` on it is cut by the query's largest coordinate: at cosine t a unit vector's coordinate
  cannot be further from the query's than the angle allows;
* products are computed for what is left.

The first pass gives every query a threshold from one bucket; the second searches all buckets with it, and each pair of bucket and query block returns
at most k rows a query. Queries come in blocks of ``QUERY_BLOCK``; every candidate bucket meets every query block once, so memory is a bucket and a block, and nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate. An empty vector, and one of another length than the query's, is no candidate for it.
A query with fewer than k candidates returns all. Rows that repeat a vec_id are candidates of their own, but not of a query of the same vec_id. A repeated query row is one query, and query rows of one vec_id with different vectors are
answered together. Null ids are never queries, and rank after others in a tie. Scaled components and scores beyond the limits of a long are at the limit, and tie there.
An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.llm.frames import settled

K = 10
SCALE = 1024
BUCKET = 8192
QUERY_BLOCK = 2048
CLASSES_PER_DOUBLING = 4
BY_COORDINATE = 0.5
LARGEST = 2.0**62
LAST = np.iinfo(np.int64).max


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, v, norm, dim`` of the vectors that take part."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(
        c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    numbers = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = vectors.where(usable).select(F.col(key).cast("long").alias("id"), numbers.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumns({"norm": F.sqrt(squares), "dim": F.size("v")})


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def _products(queries: np.ndarray, rows: np.ndarray, reach: float) -> np.ndarray:
    """Exact inner products; ``reach`` bounds a query's length times a row's, and so every partial sum."""
    if reach < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _long_products(query: np.ndarray, rows: np.ndarray, reach: float, k: int) -> np.ndarray:
    """Inner products of any size, those beyond a long's limits at the limit. Only what may be among the k best is exact; the rest has a score below those."""
    near = rows.astype(np.float64) @ query.astype(np.float64)
    error = reach * (len(query) + 4) * 2.0**-52
    least = -np.inf if len(near) <= k else np.partition(near, len(near) - k)[len(near) - k] - 2 * error
    # scores at a limit are ties
    least = min(least, float(LAST) - error)
    wanted = np.flatnonzero(near >= least) if least > -float(LAST) + error else np.arange(len(near))
    out = np.full(len(near), -LAST)
    own = query.astype(object)
    for j in wanted.tolist():
        out[j] = max(-LAST, min(LAST, int(own @ rows[j].astype(object))))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        place = np.flatnonzero(scores >= edge)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def search_bucket(queries: dict, rows: dict, k: int) -> list[tuple[int, int, int]]:
    """(query row, candidate row, score) of the k best of the bucket for each query, where they can reach its threshold.

    Both sides hold ``id``, ``v`` and ``norm``; queries hold ``floor``, a score that k candidates reach, or the smallest number.
    """
    order = np.argsort(-rows["norm"], kind="stable")
    norm, vectors, ids = rows["norm"][order], rows["v"][order], rows["id"][order]
    unit = vectors / np.maximum(norm, 1e-300)[:, None]
    slack = 1e-9
    out = []
    longest = norm[0] if len(norm) else 0.0
    alive = queries["norm"] * longest * (1 + slack) >= queries["floor"]
    plain = []
    for q in np.flatnonzero(alive).tolist():
        floor, length = float(queries["floor"][q]), float(queries["norm"][q])
        if length * longest >= LARGEST:
            some = np.flatnonzero(ids != queries["id"][q])
            scores = _long_products(queries["v"][q], vectors[some], length * longest, k)
            out += [(q, int(order[some[j]]), int(scores[j])) for j in _best(scores, ids[some], k) if scores[j] >= queries["floor"][q]]
            continue
        local = floor / (length * longest) if floor > 0 and length * longest > 0 else 0.0
        if local < BY_COORDINATE:
            plain.append(q)
            continue
        # by coordinate: cosine of at least ``local`` bounds how far the largest coordinate may be from the query's
        own = queries["v"][q] / length
        f = int(np.argmax(np.abs(own)))
        room = math.sqrt(max(0.0, 1 - local * local)) * math.sqrt(max(0.0, 1 - float(own[f]) ** 2)) + slack
        some = np.flatnonzero((unit[:, f] >= local * own[f] - room) if own[f] > 0 else (unit[:, f] <= local * own[f] + room))
        some = some[(length * norm[some] * (1 + slack) >= floor) & (ids[some] != queries["id"][q])]
        if len(some):
            scores = _products(queries["v"][q:q + 1], vectors[some], length * longest)[0]
            some, scores = some[scores >= floor], scores[scores >= floor]
            out += [(q, int(order[some[j]]), int(scores[j])) for j in _best(scores, ids[some], k)]
    for at in range(0, len(plain), 256):
        part = np.array(plain[at:at + 256])
        floor = queries["floor"][part].astype(float)
        need = np.where((floor > 0) & (queries["norm"][part] > 0), floor / np.maximum(queries["norm"][part], 1e-300), 0.0)
        stop = int(np.searchsorted(-norm, -need.min() * (1 - slack), side="right"))
        scores = _products(queries["v"][part], vectors[:stop], float(queries["norm"][part].max()) * longest)
        for row, q in enumerate(part.tolist()):
            some = np.flatnonzero((scores[row] >= queries["floor"][q]) & (ids[:stop] != queries["id"][q]))
            out += [(q, int(order[some[j]]), int(scores[row][some[j]])) for j in _best(scores[row][some], ids[some], k)]
    return out


def _side(table: pa.Table, dim: int) -> dict:
    out = {"id": table["id"].fill_null(LAST).to_numpy(), "norm": table["norm"].to_numpy(), "v": _matrix(table["v"], dim)}
    out["floor"] = table["floor"].fill_null(-LAST).to_numpy() if "floor" in table.column_names else np.full(table.num_rows, -LAST)
    return out


def _search(k: int):
    def run(group: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = rows["dim"][0].as_py()
        queries = queries.rename_columns([c.removeprefix("q_") for c in queries.column_names])
        found = np.array(search_bucket(_side(queries, dim), _side(rows, dim), k), dtype=np.int64).reshape(-1, 3)
        return pa.table({"query_id": queries["id"].take(pa.array(found[:, 0])), "vec_id": rows["id"].take(pa.array(found[:, 1])),
                         "score": found[:, 2]})
    return run


FOUND = "query_id long, vec_id long, score long"


def _meet(rows: DataFrame, queries: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Search the pairs of candidate bucket and query block in ``places``: ``dim, class, chunk, block``."""
    on = ["dim", "class", "chunk", "block"]
    left = rows.join(places, ["dim", "class", "chunk"])
    right = queries.join(places, ["dim", "block"])
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])
    return left.groupBy(*on).cogroup(right.groupBy(*[f"q_{c}" for c in on])).applyInArrow(_search(k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (``is_query`` over column ``id``) its k best other rows."""
    rows = settled(whole_numbers(vectors, key, vector, scale).withColumn(
        "class", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * CLASSES_PER_DOUBLING)).otherwise(-1).cast("int")))
    # a length class with many vectors is cut into chunks by hash; equal vectors spread by their ids
    counts = rows.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    counts = settled(counts.withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int")))
    sized = counts.select(F.col("dim").alias("d"), F.col("class").alias("c"), "chunks")
    same = (F.col("dim") == F.col("d")) & (F.col("class") == F.col("c"))
    rows = rows.join(sized, same).withColumn(
        "chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int")).select("id", "v", "norm", "dim", "class", "chunk")
    chosen = rows.where(F.col("id").isNotNull() & is_query).select("id", "v", "norm", "dim").distinct()
    per_dim = chosen.groupBy(F.col("dim").alias("d")).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    queries = settled(chosen.join(per_dim, F.col("dim") == F.col("d")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "norm", "dim", "block"))
    blocks = queries.select("dim", "block").distinct()
    # first pass: the bucket of the longest vectors gives each query a score that k candidates reach
    first = counts.groupBy("dim").agg(F.max("class").alias("class")).withColumn("chunk", F.lit(0))
    start = _meet(rows, queries, first.join(blocks, "dim"), k)
    floor = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    ready = queries.join(floor.withColumnRenamed("query_id", "id"), "id", "left")
    ready = settled(ready)
    # second pass: every bucket that can still reach the threshold of some query of the block
    reach = ready.groupBy("dim", "block").agg(F.min(F.coalesce(F.col("floor"), F.lit(-LAST)) / F.greatest(F.col("norm"), F.lit(1e-300))).alias("need"))
    places = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(reach, "dim").where(
        F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "class", "chunk", "block")
    found = _meet(rows, ready, places, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
