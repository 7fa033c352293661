"""Centroid clustering: plain Lloyd rounds on integer vectors, exact in 64 bits.

The centroids (at most `k` rows) travel to every task; a task works out all squared differences with NumPy and takes the
nearest centroid, the lower number of equal ones; each task hands on one sum for each cluster, which a groupBy merges.

Results for odd input: vectors of another length, null ones and those with a null or non-finite component are left out;
a repeated row counts each time; a null id hashes like an empty one; equal hashes (repeated ids) go by the vectors;
with fewer than `k` vectors each is a centroid; an empty table gives an empty table; other columns are ignored. A
component of 2^27 steps or more, whose distances a long could not hold, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SIZE = 64
SCALE = 64
K = 16
ROUNDS = 3
SEED = 1
MOST = 1 << 27


def steps(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and q, the whole steps of 1/scale at or below each component, of the vectors that can be kept."""
    x = vectors[embedding]
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale)).cast("array<int>")
    return vectors.where((F.size(x) == size) & finite).select(vectors[vec_id].alias("vec_id"), q.alias("q"))


def seeds(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose seeded ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["q"] for r in kept.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance."""
    if len(x) and max(x.max(), -x.min()) >= MOST:
        raise ValueError(f"components of {MOST} steps or more")
    far = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = x - centroid
        far[:, c] = np.einsum("ij,ij->i", apart, apart)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster]


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors, component by component; empty ones stay."""
    k, size = centroids.shape

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            if len(frame):
                x = np.stack(frame["q"].to_numpy()).astype(np.int64)
                cluster, _ = nearest(x, centroids)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
                n += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "total": list(total[used])})

    parts = kept.select("q").mapInPandas(sums, "cluster int, n long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size)])
    out = centroids.copy()
    for row in merged.collect():  # a row for each centroid at most
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, far = nearest(np.stack(frame["q"].to_numpy()).astype(np.int64), centroids)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": far})

    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return kept.select("vec_id", "q").mapInPandas(assign, schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids)."""
    kept = cut(steps(vectors, size, scale))
    centroids = seeds(kept, k, seed).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    return assigned(kept, centroids) if len(centroids) else kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """The clusters of all vectors with the inertia of each and of all, and the hash of each centroid."""
    rows, centroids = cluster(vectors, **options)
    rows = cut(rows)
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = [(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(hashes)]
    table = rows.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(size: int = SIZE, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in DuckDB."""
    parts = [
        f"""with kept as materialized (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as q from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}
), c0 as materialized (
  select row_number() over (order by key, q) - 1 as k, q
  from (select sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as key, q from kept order by key, q limit {k})
)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (
  select id, any_value(vec_id) as vec_id, any_value(q) as q, min({{'d': d, 'k': k}}) as best from (
    select v.id, v.vec_id, v.q, c.k, cast(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from kept v, c{r} c
  ) group by id
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (
  select o.k, coalesce(m.q, o.q) as q from c{r} o left join (
    select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as q from (
      select best.k as k, place, sum(v) as s, count(*) as n from (select best, unnest(q) as v, unnest(range({size})) as place from a{r}) group by 1, 2
    ) group by k
  ) m on m.k = o.k
)""")
    return ",\n".join(parts) + f"""
select vec_id, cast(best.k as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.k) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.k = a.best.k"""
