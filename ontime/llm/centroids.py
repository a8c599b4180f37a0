"""k-means on integer vectors by an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids. When centroids move, only the components in
which one changed are multiplied, by the change, and added; squared distances follow from the dot products and the squared
lengths of both sides, and the nearest centroid is found again. The state (vector, dot products, cluster) is a
written table after each round, so a lost executor costs part of a round, and reading
another round's state never repeats an earlier one. Sums by cluster are combined before the shuffle; only k centroids, as
sums of ``WIDTH`` numbers, reach the driver, so a cluster of any size is no hot group.

Vectors of another length, null ones and those with null or non-finite components are left
out. A component beyond ``LARGEST`` fails the job, as squared distances then leave 64 bits. Repeated rows are
vectors each; equal hashes are dealt by component order. With fewer than k vectors, there are as many
centroids as vectors; without vectors there are no rows. A null vec_id hashes as an empty one.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontime.sources.shared import materialize

WIDTH, SCALE = 64, 64  #: components of a vector, and the factor that makes them integers
K, ROUNDS, SEED = 16, 3, 1
LARGEST = 1 << 22  #: of a component; 64 squares of 64 times as much stay below 2**63

_STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def integer_vectors(table: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>): the vectors of ``width`` finite components, scaled and floored."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = table.filter((F.size("embedding") == width) & F.coalesce(finite, F.lit(False)))

    def whole(v: Column) -> Column:
        large = F.raise_error(F.lit(f"a component is beyond {LARGEST}"))
        return F.when(F.abs(v) <= LARGEST, F.floor(v * scale).cast("int")).otherwise(large.cast("int"))

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _advance(batches: Iterator[pa.RecordBatch], old: np.ndarray | None, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors with their dot products and nearest centroids, from those of the ``old`` centroids."""
    lengths = (new**2).sum(1)
    change = new if old is None else new - old
    moved = [np.flatnonzero(row) for row in change]
    for batch in batches:
        n = batch.num_rows
        x = batch["x"].flatten().to_numpy().astype(np.int64).reshape(n, new.shape[1])
        dots = np.zeros((n, len(new)), np.int64) if old is None else batch["dots"].flatten().to_numpy().reshape(n, len(new)).copy()
        for c, at in enumerate(moved):
            if len(at):
                dots[:, c] += x[:, at] @ change[c, at]
        distances = lengths - 2 * dots + (x**2).sum(1)[:, None]
        cluster = distances.argmin(1)
        ends = pa.array(np.arange(n + 1) * len(new), pa.int32())
        columns = [batch["vec_id"], batch["x"], pa.ListArray.from_arrays(ends, pa.array(dots.ravel(), pa.int64()))]
        columns += [pa.array(cluster, pa.int32()), pa.array(distances[np.arange(n), cluster], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "dots", "cluster", "distance"])


def assign(state: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """The state of the ``new`` centroids: from plain vectors if ``old`` is None, else from the state of the old ones."""
    return materialize(state.mapInArrow(lambda batches: _advance(batches, old, new), _STATE), "distances")


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; empty ones keep theirs."""
    sums = [F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    made = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        made[row.cluster] = [total // row.n for total in row[2:]]
    return made


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment, and the centroids that it is of."""
    vectors = materialize(vectors, "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _STATE), centroids
    state = assign(vectors, None, centroids)
    for _ in range(rounds):
        new = moved_centroids(state, centroids)
        state, centroids = assign(state, centroids, new), new
    return state, centroids


def op13_centroid_clustering(table: DataFrame) -> DataFrame:
    """Cluster, squared distance, inertias and digest of the centroid of each vector."""
    state, centroids = cluster(integer_vectors(table))
    spark = table.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    inertias = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertias = inertias.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # of k rows
    figures = inertias.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return state.join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql() -> str:
    """DuckDB SQL of op13_centroid_clustering."""
    steps = [
        f"""e as materialized (select vec_id, unnest(generate_series(1, {WIDTH})) as i,
  unnest(list_transform(embedding, lambda v: cast(floor({SCALE} * cast(v as double)) as bigint))) as x
  from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda v: isfinite(v))) = {WIDTH})""",
        f"""c0 as materialized (select k, i, x as c from e join (select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as k
  from (select distinct vec_id from e) qualify k < {K}) using (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (select vec_id, k, d from (
    select vec_id, k, cast(sum((x - c) * (x - c)) as bigint) as d from e join c{r} using (i) group by vec_id, k)
  qualify row_number() over (partition by vec_id order by d, k) = 1)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} as materialized (select c{r}.k, c{r}.i, coalesce(m.c, c{r}.c) as c from c{r} left join (
    select k, i, cast(floor(sum(x) / count(*)) as bigint) as c from e join a{r} using (vec_id) group by k, i) m
  on m.k = c{r}.k and m.i = c{r}.i)""")
    last = ROUNDS
    return f"""with {", ".join(steps)}
select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a{last} join (select k, sha256(string_agg(cast(c as varchar), ',' order by i)) as centroid_sha256 from c{last} group by k) using (k)"""


#: For tables whose vec_ids don't repeat.
OP13_SQL = _sql()
