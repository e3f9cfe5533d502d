"""Exact dense search over vectors that lie in clusters, with the triangle inequality to leave clusters unread.

Centers come from a bounded sample; every vector is written once, to the folder of the center at the least angle, and a cluster's
radius is the greatest angle in it. No vector of a cluster is nearer to a query than the angle to its center less the radius. A
search reads for each query the clusters with the least such bounds until they hold n vectors, takes the angle of the n-th best as a
threshold, and then reads the clusters whose bound is below it. Vectors stay in their clusters; what is shuffled to them is the
queries that need them, and a cluster of many vectors is searched in slabs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.evals import sample
from skein.operators.retrieval import SLAB, TOP, best_of, ranked, unit
from skein.sources.tables import kept, shared_dir

#: Most centers of one length, vectors of the sample for each center, rounds of k-means over the sample.
CENTERS, PER_CENTER, ROUNDS = 1024, 32, 8
#: Queries that meet a slab in one task; more of them take the slab to more tasks.
BLOCK = 4096
#: Angles are compared with this slack, far above their rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class ClusterIndex:
    """Vectors by cluster in a folder (cluster, slab, chunk_id, embedding); clusters as (length, center or None, radius, n, slabs)."""

    spark: SparkSession
    path: str
    clusters: list

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("chunk_id long, embedding array<float>, slab int, cluster int").parquet(self.path)


def centers(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k directions by spherical k-means, from rows of length one."""
    found = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (vectors @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, vectors)
        size = np.sqrt((sums * sums).sum(1))
        found = np.where(size[:, None] > 0, sums / np.where(size, size, 1)[:, None], found)
    return found


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows and unit vectors of those of that length."""
    for n in np.unique(np.diff(column.offsets.to_numpy())).tolist():
        if n:
            yield (n, *unit(column, n))


def build(vectors: DataFrame, path: str | None = None, most: int = CENTERS, slab: int = SLAB, seed: int = 0) -> ClusterIndex:
    """Writes the index of ``vectors`` (chunk_id, embedding) to ``path``, by default in the shared folder; null vectors and those without a length are left out.

    Each length of vectors has clusters of its own, as many as the root of their number, at most ``most``. A length that the sample
    has not seen has one cluster without a center, which is always read.
    """
    spark = vectors.sparkSession
    path = path or f"{shared_dir(spark)}/skein-clusters-{uuid.uuid4().hex}"
    known = vectors.select("chunk_id", "embedding").where(F.col("embedding").isNotNull())
    total = known.count()
    wanted = max(1, min(most, int(total**0.5)))
    picked = sample(known, wanted * PER_CENTER, seed, ["chunk_id"]).toArrow()  # bounded by most * PER_CENTER
    table: list[tuple[int, np.ndarray | None]] = []
    if picked.num_rows:
        for n, _, rows in _by_length(picked["embedding"].combine_chunks()):
            k = max(1, round(wanted * len(rows) / picked.num_rows))
            table += [(n, c) for c in centers(rows, min(k, len(rows)))] if len(rows) else []
    seen = sorted({n for n, _ in table})
    shared = spark.sparkContext.broadcast(table)

    def assigned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {n: (np.array([i for i, (m, _) in enumerate(shared.value) if m == n]), np.array([c for m, c in shared.value if m == n])) for n in seen}
        for batch in parts:
            column = batch.column(1)
            for n, rows, units in _by_length(column):
                if not len(rows):
                    continue
                if n in by_length:
                    which, found = by_length[n]
                    score = units @ found.T
                    near = score.argmax(1)
                    cluster, angle = which[near], np.arccos(np.clip(score[np.arange(len(near)), near], -1, 1))
                else:
                    cluster, angle = np.full(len(rows), -n), np.full(len(rows), np.pi)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), column.take(take), pa.array(cluster.astype(np.int32)), pa.array(angle)], names=["chunk_id", "embedding", "cluster", "angle"])

    rows = kept(known.mapInArrow(assigned, "chunk_id long, embedding array<float>, cluster int, angle double"), "assigned")
    sizes = rows.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    sizes = sizes.withColumn("slabs", F.ceil(F.col("n") / slab).cast("int"))
    found = sizes.collect()  # a row for each center, and for each length that the sample has not seen
    dealt = rows.join(F.broadcast(sizes.select("cluster", "slabs")), "cluster").withColumn("slab", F.pmod(F.xxhash64("chunk_id"), F.col("slabs")).cast("int"))
    dealt.select("chunk_id", "embedding", "slab", "cluster").repartition("cluster", "slab").write.partitionBy("cluster").parquet(path)
    known_clusters = [(r.cluster, *(table[r.cluster] if r.cluster >= 0 else (-r.cluster, None)), r.radius, r.n, r.slabs) for r in found]
    return ClusterIndex(spark, path, sorted(known_clusters, key=lambda c: c[0]))


def chosen(index: ClusterIndex, queries: DataFrame, n: int = TOP) -> DataFrame:
    """query_id, qv, cluster, slabs: the clusters that a query reads, those with the least bounds until they hold n vectors, or, with a column ``least`` (the n-th best score, null if there is none) all others that may hold as near a vector.

    A query without a length, or of a length that no vector has, has none.
    """
    shared = index.spark.sparkContext.broadcast(index.clusters)
    again = "least" in queries.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list] = {}
        for c in shared.value:
            by_length.setdefault(c[1], []).append(c)
        ready = {m: (np.array([c[2] if c[2] is not None else np.zeros(m) for c in cs]), np.array([c[2] is not None for c in cs]), *(np.array([c[i] for c in cs]) for i in (0, 3, 4, 5))) for m, cs in by_length.items()}
        for whole in parts:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                column = pa.concat_arrays([batch.column(1)])
                for m, rows, units in _by_length(column):
                    if m not in ready or not len(rows):
                        continue
                    center, has, name, radius, size, slabs = ready[m]
                    bound = np.where(has, np.maximum(np.arccos(np.clip(units @ center.T, -1, 1)) - radius, 0), 0)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.take_along_axis(np.cumsum(size[order], axis=1) - size[order], np.argsort(order, axis=1, kind="stable"), axis=1)
                    first = before < n
                    if again:
                        least = column_of(batch, 2)[rows]
                        reach = np.where(np.isnan(least), 4.0, np.arccos(np.clip(least, -1, 1)) + SLACK)
                        pick = ~first & (bound <= reach[:, None])
                    else:
                        pick = first
                    i, c = np.nonzero(pick)
                    take = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), column.take(take), pa.array(name[c].astype(np.int32)), pa.array(slabs[c].astype(np.int32))], names=["query_id", "qv", "cluster", "slabs"])

    names = ["query_id", "embedding", *(["least"] if again else [])]
    return queries.where(F.col("embedding").isNotNull()).select(*names).mapInArrow(run, "query_id long, qv array<float>, cluster int, slabs int")


def column_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(float)


def _best(index: ClusterIndex, pairs: DataFrame, n: int, within: DataFrame | None) -> DataFrame:
    """The n best of each query in each slab of its clusters."""
    pairs = kept(pairs.withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))), "pairs")
    blocks = pairs.groupBy("cluster", "slab").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(blocks, ["cluster", "slab"]).withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    vectors = index.vectors()
    if within is not None:
        vectors = vectors.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi")
    have = vectors.join(blocks, ["cluster", "slab"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "slab", "b"]
    return asked.select(*keys, "query_id", "qv").groupBy(*keys).cogroup(have.select(*keys, "chunk_id", "embedding").groupBy(*keys)).applyInArrow(best_of(n), "query_id bigint, chunk_id bigint, score double")


def search(index: ClusterIndex, queries: DataFrame, n: int = TOP, within: DataFrame | None = None) -> DataFrame:
    """The ranked lists of retrieval.dense_search, row for row: queries (query_id, embedding) against all vectors of the index.

    ``within`` (chunk_id) limits the search; the bounds hold for any part of a cluster.
    """
    early = kept(_best(index, chosen(index, queries, n), n, within), "early")
    nth = ranked(early, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    rest = chosen(index, queries.join(nth, "query_id", "left"), n)
    return ranked(early.unionByName(_best(index, rest, n, within)), n)


def reads(index: ClusterIndex, queries: DataFrame, n: int = TOP) -> DataFrame:
    """For each query: clusters (of vectors of its length) and read (those that a search opens)."""
    first = kept(chosen(index, queries, n), "chosen")
    nth = ranked(_best(index, first, n, None), n).where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
    opened = first.unionByName(chosen(index, queries.join(nth, "query_id", "left"), n)).groupBy("query_id").agg(F.count("*").alias("read"), F.size(F.first("qv")).alias("length"))
    total = index.spark.createDataFrame([(n_, sum(c[1] == n_ for c in index.clusters)) for n_ in sorted({c[1] for c in index.clusters})], "length int, clusters long")
    return opened.join(total, "length").select("query_id", "clusters", "read")
