"""Approximate search by inverted lists: k-means on a bounded sample, every row written under its list, nearest lists read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import COSINE, DOT_PRODUCT, lower_is_better, metric_of, score
from ..sources.shared import shared_folder
from ..store import VectorStore, quoted
from .filters import Filter
from .search import candidates, search_batch, search_by_vector

MOST_LISTS = 4096


def _with_list(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("list", IntegerType())])


def _near(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to all centers, up to what is the same for each of them."""
    return (centers * centers).sum(axis=1)[None, :] - 2 * (v.astype(float) @ centers.T)


#: More than rounding can make of an angle, or of a distance or product in proportion to its terms.
SLACK = 1e-6


@dataclass(frozen=True)
class IvfIndex:
    """``rows`` are all live rows of the store with ``list``, that of the nearest center, in a table partitioned by it.

    ``spread`` has for each list the greatest distance and the greatest angle of its rows from its center.
    """

    store: VectorStore
    centers: np.ndarray
    rows: DataFrame
    spread: np.ndarray

    @staticmethod
    def build(store: VectorStore, lists: int | None = None, sample: int = 50_000, seed: int = 7, folder: str | None = None) -> IvfIndex:
        """Centers are fitted on about ``sample`` rows, taken by a hash of the id; every row is indexed.

        The number of lists is by default about the root of the number of rows.  Rows (ids, positions, vectors
        and promoted fields) are written to ``folder`` with a directory for each list, the centers and how far
        the rows of each are from it beside them.
        """
        spark, live = store.rows.sparkSession, store.live()
        n = live.count()
        lists = lists or min(MOST_LISTS, max(8, math.isqrt(n)))
        share = min(1.0, sample / max(n, 1))
        some = live.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=15).fit(some)
        centers = np.array(model.clusterCenters(), float)
        dimension, folder = store.definition.dimension, folder or shared_folder(spark, "ivf")
        rows = live.select("id", "seq", "vector", *[quoted(c) for c in store.definition.indexed])
        at = rows.columns.index("vector")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, dimension)
                nearest = _near(v, centers).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[*batch.schema.names, "list"])

        dealt = rows.mapInArrow(assign, _with_list(rows))
        dealt.repartitionByRange("list", "seq").sortWithinPartitions("list", "seq").write.partitionBy("list").parquet(f"{folder}/rows")

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, dimension).astype(float)
                c = centers[np.asarray(batch.column(0))]
                length = np.sqrt((v * v).sum(axis=1)) * np.sqrt((c * c).sum(axis=1))
                cosine = np.where(length == 0, -1.0, (v * c).sum(axis=1) / np.where(length == 0, 1.0, length))
                far = [np.sqrt(((v - c) ** 2).sum(axis=1)), np.arccos(np.clip(cosine, -1, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, far)], names=["list", "distance", "angle"])

        far = spark.read.schema(_with_list(rows)).parquet(f"{folder}/rows").select("list", "vector").mapInArrow(ends, "list int, distance double, angle double")
        spread = {r["list"]: (r["distance"], r["angle"]) for r in far.groupBy("list").agg(F.max("distance").alias("distance"), F.max("angle").alias("angle")).collect()}  # a row a list
        named = [(k, c.tolist(), *spread.get(k, (0.0, 0.0))) for k, c in enumerate(centers)]
        spark.createDataFrame(named, "list int, center array<double>, distance double, angle double").coalesce(1).write.parquet(f"{folder}/centers")
        return IvfIndex.load(store, folder)

    @staticmethod
    def load(store: VectorStore, folder: str) -> IvfIndex:
        """An index that was built over this version of the store."""
        spark = store.rows.sparkSession
        centers = sorted(spark.read.parquet(f"{folder}/centers").collect())  # MOST_LISTS rows at most
        names = [*store.definition.indexed]
        schema = _with_list(store.rows.select("id", "seq", "vector", *[quoted(c) for c in names]))
        spread = np.array([(r["distance"], r["angle"]) for r in centers], float)
        return IvfIndex(store, np.array([r["center"] for r in centers], float), spark.read.schema(schema).parquet(f"{folder}/rows"), spread)

    def nearest_lists(self, vector: list[float], probes: int) -> list[int]:
        return [int(k) for k in np.argsort(_near(np.array([vector], float), self.centers)[0], kind="stable")[:probes]]

    def able_lists(self, vector: list[float], worst: float) -> list[int]:
        """Lists that may have a row whose score is ``worst`` or better, by the distance or angle of the query from their centers."""
        q, (distance, angle), metric = np.array(vector, float), self.spread.T, metric_of(self.store.definition.metric)
        length, lengths = np.sqrt((q * q).sum()), np.sqrt((self.centers * self.centers).sum(axis=1))
        if metric == DOT_PRODUCT:
            able = self.centers @ q + length * (distance + SLACK * (lengths + distance)) >= worst - SLACK * abs(worst)
        elif metric == COSINE:
            known = (length > 0) & (lengths > 0)
            apart = np.arccos(np.clip(np.where(known, self.centers @ q / np.where(known, length * lengths, 1), 1), -1, 1))
            able = ~known | (np.cos(np.maximum(apart - angle - SLACK, 0)) >= worst - SLACK)
        else:
            apart = np.sqrt(((self.centers - q) ** 2).sum(axis=1))
            able = apart - distance <= worst + SLACK * (length + lengths + distance + worst)
        return np.flatnonzero(able).tolist()

    def probed(self, vector: list[float], probes: int, condition: Filter | None = None) -> DataFrame:
        """Rows of the lists nearest to the query: the scan reads their directories only."""
        return self._of(self.nearest_lists(vector, probes), condition)

    def _of(self, lists: list[int], condition: Filter | None) -> DataFrame:
        rows = self.rows if len(lists) == len(self.centers) else self.rows.where(F.col("list").isin(lists))
        return rows if condition is None else rows.where(condition.column(self.store.definition.indexed))

    def _best(self, rows: DataFrame, vector: list[float], top_k: int) -> DataFrame:
        metric = metric_of(self.store.definition.metric)
        rows = rows.withColumn("score", score(metric, F.col("vector"), F.lit([float(x) for x in vector])))
        order = F.col("score").asc() if lower_is_better(metric) else F.col("score").desc()
        return rows.select("id", "seq", "score").orderBy(order, "seq").limit(max(top_k, 1))

    def search(self, vector: list[float], top_k: int = 10, probes: int = 4, condition: Filter | None = None) -> DataFrame:
        """``id, seq, score``: exact scores within the ``probes`` lists whose centers are nearest to the query.

        ``condition`` may use promoted fields.
        """
        return self._best(self.probed(vector, probes, condition), vector, top_k)

    def search_exact(self, vector: list[float], top_k: int = 10, probes: int = 4, condition: Filter | None = None) -> DataFrame:
        """``id, seq, score`` of the exact best ``top_k``: the worst score that the nearest lists give tells which others are read too.

        ``condition`` may use promoted fields.
        """
        worst = F.max("score") if lower_is_better(metric_of(self.store.definition.metric)) else F.min("score")
        n, worst = self.search(vector, top_k, probes, condition).agg(F.count(F.lit(1)), worst).first()
        lists = self.able_lists(vector, worst) if n == max(top_k, 1) else list(range(len(self.centers)))
        return self._best(self._of(lists, condition), vector, top_k)

    def search_routed(self, vector: list[float], top_k: int = 10, condition: Filter | None = None, probes: int = 4, flat_below: int = 10_000) -> tuple[str, DataFrame]:
        """The route, FLAT or IVF, and its hits.

        Up to ``flat_below`` candidates after the filter are searched exactly, which costs no more than the
        lists; more are searched in the lists, where a filter may use promoted fields only.  Both are exact.
        """
        few = candidates(self.store, condition).select("id").limit(flat_below + 1).count() <= flat_below
        if few:
            return "FLAT", search_by_vector(self.store, vector, top_k, condition=condition, payload=False)
        return "IVF", self.search_exact(vector, top_k, probes, condition)

    def recall(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """``probes, recall``: share of the exact ``top_k`` of all ``queries`` (``query_id, vector``) found with so many lists.

        Scores within a list are exact, so a neighbour is found as soon as its list is probed.
        """
        centers, dimension = self.centers, self.store.definition.dimension
        exact = search_batch(self.store, queries, top_k).select("query_id", "id")

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, dimension)
                place = np.argsort(np.argsort(_near(v, centers), axis=1, kind="stable"), axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(place.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "place"])

        near = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").mapInArrow(order, "query_id string, place array<int>")
        found = exact.join(near, "query_id").join(self.rows.select("id", "list"), "id").select(F.get("place", F.col("list")).alias("place"))
        counted = found.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a list
        counts = np.bincount([r["place"] for r in counted], weights=[r["n"] for r in counted], minlength=len(centers)) if counted else np.zeros(len(centers))
        shares = np.cumsum(counts) / max(counts.sum(), 1)
        return queries.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(shares)], "probes int, recall double")

    def enough(self, recall: float = 0.92, top_k: int = 10, sample: int = 256) -> int:
        """Least number of probes with the recall over about ``sample`` rows as queries, taken by a hash of the id."""
        live = self.store.live()
        share = min(1.0, sample / max(live.count(), 1))
        queries = live.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col("id").alias("query_id"), "vector")
        met = [r["probes"] for r in self.recall(queries, top_k).collect() if r["recall"] >= recall]  # a row a list
        return min(met, default=len(self.centers))
