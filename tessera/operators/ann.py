"""Nearest neighbours: exact, by locality-sensitive hashing, and by clusters.

``search`` gives the k nearest as (id, distance), distance being one less the
cosine.  The exact index also stands for the graph index of the dialect, whose
contract it meets with full recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.builtin import dot, norm

#: Query vectors that one broadcast block of a batch search holds.
BLOCK_QUERIES = 1024


def cosine_distance(a, b):
    """One less the cosine; 1 for a zero vector, infinity for unlike dimensions."""
    lengths = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).when(lengths == 0, 1.0).otherwise(1.0 - dot(a, b) / lengths)


def _query(vector):
    return F.array(*[F.lit(float(x)) for x in vector])


class ExactIndex:
    """A scan and a top-k, over the vectors as they are."""

    def __init__(self, rows: DataFrame, id_: str = "id", vector: str = "vector"):
        self.rows = rows.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def insert(self, rows: DataFrame) -> None:
        self.rows = self.rows.unionByName(rows.select("id", F.col("vector").cast("array<double>").alias("vector")))

    def remove(self, ids: list) -> None:
        self.rows = self.rows.where(~F.col("id").isin(ids))

    def candidates(self, query) -> DataFrame:
        return self.rows

    def search(self, query, k: int) -> DataFrame:
        ranked = self.candidates(query).select("id", cosine_distance(F.col("vector"), _query(query)).alias("distance"))
        return ranked.orderBy("distance", "id").limit(k)

    def __len__(self) -> int:
        return self.rows.count()


class LshIndex(ExactIndex):
    """Buckets of random projections; what shares a bucket with the query is ranked exactly."""

    def __init__(self, rows: DataFrame, id_: str = "id", vector: str = "vector", tables: int = 4, width: float = 4.0, seed: int = 0):
        super().__init__(rows, id_, vector)
        self.model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed).fit(self._features())

    def _features(self) -> DataFrame:
        return self.rows.withColumn("features", array_to_vector("vector"))

    def candidates(self, query) -> DataFrame:
        one = self.rows.sparkSession.createDataFrame([(Vectors.dense([float(x) for x in query]),)], ["features"])
        own = [float(v[0]) for v in self.model.transform(one).first()["hashes"]]
        hashes = self.model.transform(self._features())
        shares = None
        for i, value in enumerate(own):
            same = vector_to_array(F.col("hashes")[i])[0] == value
            shares = same if shares is None else shares | same
        return hashes.where(shares).select("id", "vector")


class IvfIndex(ExactIndex):
    """Cells of k-means centres of the vectors' directions.

    ``candidates`` has the cells nearest to the query; ``search`` also takes
    every other cell that can hold something as near as the k-th of those, so
    its recall is 1.
    """

    def __init__(self, rows: DataFrame, id_: str = "id", vector: str = "vector", cells: int = 8, probes: int = 1, iterations: int = 10, seed: int = 0):
        super().__init__(rows, id_, vector)
        self.probes = probes
        self.model = KMeans(k=cells, maxIter=iterations, seed=seed, featuresCol="features", predictionCol="cell").fit(self._features())
        self.centres = np.array(self.model.clusterCenters())
        self.radii = None

    def insert(self, rows: DataFrame) -> None:
        super().insert(rows)
        self.radii = None

    def _features(self) -> DataFrame:
        length = norm(F.col("vector"))
        unit = F.when(length == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x / length))
        return self.rows.withColumn("features", array_to_vector(unit))

    def _placed(self) -> DataFrame:
        return self.model.transform(self._features())

    def _apart(self, query) -> np.ndarray:
        q = np.array(query, float)
        return np.linalg.norm(self.centres - q / max(np.linalg.norm(q), 1e-300), axis=1)

    def _of_cells(self, cells) -> DataFrame:
        return self._placed().where(F.col("cell").isin([int(c) for c in cells])).select("id", "vector")

    def candidates(self, query) -> DataFrame:
        return self._of_cells(np.argsort(self._apart(query))[: self.probes])

    def _bounds(self, query) -> np.ndarray:
        """The least cosine distance that a vector of each cell can have, which is half the squared distance of directions."""
        if self.radii is None:
            centres = F.array(*[_query(c) for c in self.centres])
            apart = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), centres[F.col("cell")], lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda t, x: t + x))
            self.radii = np.full(len(self.centres), -np.inf)
            for cell, radius in self._placed().groupBy("cell").agg(F.max(apart)).collect():
                self.radii[cell] = radius
        return np.maximum(self._apart(query) - self.radii, 0) ** 2 / 2

    def search(self, query, k: int) -> DataFrame:
        found = super().search(query, k).collect()
        reach = found[-1]["distance"] if len(found) == k > 0 else np.inf
        bounds = self._bounds(query)
        near = np.argsort(self._apart(query))[: self.probes]
        cells = np.union1d(near, np.flatnonzero((bounds <= reach + 1e-9) & np.isfinite(bounds)))
        ranked = self._of_cells(cells).select("id", cosine_distance(F.col("vector"), _query(query)).alias("distance"))
        return ranked.orderBy("distance", "id").limit(k)


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows with the highest cosine for each query.

    Queries are taken in blocks of a bounded number; in each partition a block
    product and a top-k leave k rows for each query, and a second top-k is
    taken of those.  A zero vector has cosine 0.
    """
    spark = rows.sparkSession
    out, block = None, []
    for q in queries.select(F.col(id_), F.col(vector).cast("array<double>")).orderBy(id_).toLocalIterator():
        block.append((q[0], q[1]))
        if len(block) == BLOCK_QUERIES:
            part, block = _nearest(rows, spark.sparkContext.broadcast(block), k, id_, vector), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = _nearest(rows, spark.sparkContext.broadcast(block), k, id_, vector)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(rows: DataFrame, shared, k: int, id_: str, vector: str) -> DataFrame:
    def scan(batches):
        ids = [i for i, _ in shared.value]
        if not ids:
            return
        queries = _unit(np.array([v for _, v in shared.value], float))
        # The best so far of each query; a partition passes on k rows for each.
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy()
            cosines = np.round(queries @ _unit(batch.column(1).flatten().to_numpy().reshape(len(names), -1)).T, 9)
            least = np.partition(cosines, -k, axis=1)[:, -k] if 0 < k < len(names) else np.full(len(ids), -np.inf)
            for q, (own, score) in enumerate(best):
                at = np.flatnonzero(cosines[q] >= least[q])
                own, score = np.append(own, names[at]), np.append(score, cosines[q][at])
                order = np.lexsort((own, -score))[:k]
                best[q] = own[order], score[order]
        counts = [len(own) for own, _ in best]
        columns = [pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.concatenate([own for own, _ in best])), pa.array(np.concatenate([score for _, score in best]))]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity"])

    own = rows.select(F.col(id_).cast("long"), F.col(vector).cast("array<double>"))
    return own.mapInArrow(scan, "query_id long, id long, similarity double")
