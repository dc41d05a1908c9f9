"""Centroid clustering by delta Lloyd, in whole numbers.

Vectors become integers, floor(256 * x). Assignments and distances are a written table, and the componentwise sums and counts of all
clusters are kept from round to round. In each round

* a vector whose own centroid stayed compares its old distance with the centroids that changed, and with no other; a vector whose
  own centroid moved is compared with all;
* vectors that changed their owner send signed transfers, minus their components for the old owner and plus for the new one, which
  are partial sums before the shuffle: 2 * k rows of sums reach the driver at most, whatever the number of vectors.

All is exact: the result is that of plain Lloyd rounds, whatever the partitioning or the machine. k centroids of 64 numbers are all
that tasks are sent. A round's table replaces the one before, so a lost executor costs the tasks of one round.

Cases: vectors that are null, have another length, or a component that is null, not finite or 2^19 or more in size (whose squares a
long cannot sum up) are left out; a null vec_id counts as an empty text in the hash that picks the first centroids; rows with equal
vec_id are vectors of their own, equal hashes go by components; ties of distances go to the smaller number; with fewer vectors than k
there are as many centroids as vectors; an empty table gives an empty table; other columns are left out, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components that float arithmetic multiplies and adds up exactly are below this.
_EXACT = 1 << 22


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that are kept, in whole numbers."""
    x = F.col("embedding")
    good = (F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < 2.0**19, F.lit(False)))
    return vectors.select("vec_id", "embedding").where(good).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and vec_id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select("v", h.alias("h")).orderBy("h", "v").limit(k).collect()]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all rows of c, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """vec_id, v, cluster, distance, was: each vector's nearest centroid now, and the cluster it was in before (-1 at first)."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            was, best = b.column("cluster").to_numpy(), b.column("distance").to_numpy().copy()
            now = was.copy()
            moved = (was < 0) | changed[was]
            if moved.any():
                d = distances(v[moved], centroids)
                now[moved] = d.argmin(1)
                best[moved] = d.min(1)
            if (~moved).any() and changed.any():
                which = np.flatnonzero(changed)
                d = distances(v[~moved], centroids[which])
                near, least = which[d.argmin(1)], d.min(1)
                old, mine = best[~moved], now[~moved]
                better = (least < old) | ((least == old) & (near < mine))
                best[~moved] = np.where(better, least, old)
                now[~moved] = np.where(better, near, mine)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(now), pa.array(best), pa.array(was)], names=["vec_id", "v", "cluster", "distance", "was"])

    return state.mapInArrow(released(run), f"vec_id {kind}, v array<int>, cluster int, distance bigint, was int")


def transfers(state: DataFrame, dims: int = DIMS) -> list:
    """Signed counts and sums of the vectors that came into each cluster or left it."""
    moves = F.array(F.struct(F.col("was").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")))
    rows = state.where("cluster <> was").select("v", F.explode(moves).alias("m")).where("m.at >= 0")
    sums = [F.sum(F.col("m.sign").cast("long") * F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    return rows.groupBy(F.col("m.at").alias("at")).agg(F.sum(F.col("m.sign").cast("long")).alias("n"), *sums).collect()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of its components)."""
    kept = whole_vectors(vectors, dims, scale)
    centroids = np.array(first_centroids(kept, k, seed), np.int64).reshape(-1, dims)
    n = len(centroids)
    spark = vectors.sparkSession
    counts, sums = [0] * n, [[0] * dims for _ in range(n)]
    changed = np.ones(n, bool)
    state, last = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), None
    for i in range(rounds + 1 if n else 0):
        state = written(assigned(state.select("vec_id", "v", "cluster", "distance"), centroids, changed), "assigned")
        if last is not None:
            dropped(last)
        last = state
        if i == rounds:
            break
        for r in transfers(state, dims):
            counts[r["at"]] += r["n"]
            sums[r["at"]] = [a + r[f"s{j}"] for j, a in enumerate(sums[r["at"]])]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(n)], np.int64).reshape(-1, dims)
        changed, centroids = (new != centroids).any(1), new
    if not n:
        state = assigned(state, centroids, changed)
    by = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = [(c, by.get(c, 0), sum(by.values()), centroids[c].tolist()) for c in range(n)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_sha256(centroid: list[int]) -> str:
    """The digest of a centroid's components, as in the query."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The query's rows in DuckDB SQL: plain Lloyd rounds, each over all vectors and all centroids."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rn, min({{'d': (vv - 2 * list_dot_product(k.v, c.v) + cc)::BIGINT, 'c': c}}) AS m
  FROM k, (SELECT *, list_dot_product(v, v) AS cc FROM c{i}) c GROUP BY rn)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, p, sum(x::HUGEINT) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i} JOIN k USING (rn)) GROUP BY c, p)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(f.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY p) AS v FROM s{i} GROUP BY c) f USING (c))""")
    return f"""
WITH k AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: abs(x::DOUBLE) < 524288)) = {dims})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
t AS (SELECT m.c AS c, sum(m.d)::BIGINT AS s FROM a{rounds} GROUP BY ALL)
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, s AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia, sha256(array_to_string(list_transform(f.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN k USING (rn) JOIN t ON a.m.c = t.c JOIN c{rounds} f ON a.m.c = f.c"""
