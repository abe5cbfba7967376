"""A vector store: a definition and an immutable DataFrame version; every mutation gives a new store."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from .functions import sq8
from .functions.vectors import norm
from .operators.filters import Filter
from .plans.definition import StoreDefinition


def quoted(name: str):
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _checked(rows: DataFrame, d: StoreDefinition) -> DataFrame:
    """Raises, inside the plan, on a vector that is null, of another length or not finite, and on a null id."""
    v = F.col("vector")
    good = (F.size(v) == d.dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {d.dimension} finite numbers is needed, id "), F.coalesce(F.col("id"), F.lit("null"))))
    return rows.withColumn("vector", F.when(F.coalesce(good, F.lit(False)) & F.col("id").isNotNull(), v).otherwise(wrong.cast("array<float>")))


@dataclass(frozen=True)
class VectorStore:
    """``rows`` has the definition's schema, and ``code, code_norm`` once SQ8 is frozen (``params``)."""

    definition: StoreDefinition
    rows: DataFrame
    params: sq8.Params | None = None

    # ------------------------------------------------------------ building
    @staticmethod
    def empty(spark, definition: StoreDefinition) -> VectorStore:
        return VectorStore(definition, spark.createDataFrame([], definition.schema()))

    @staticmethod
    def from_documents(docs: DataFrame, definition: StoreDefinition, order: str = "seq", check: bool = True) -> VectorStore:
        """A store of distinct documents ``id, vector[, text, metadata]`` in the order of the column ``order``.

        Promoted fields come from columns of their name if there are, else from the metadata.
        """
        rows = _shaped(docs.withColumn("seq", F.col(order).cast("long")).withColumn("deleted", F.lit(False)), definition)
        return VectorStore(definition, _checked(rows, definition) if check else rows).frozen_if_due()

    # ------------------------------------------------------------ reading
    def live(self) -> DataFrame:
        return self.rows.where(~F.col("deleted"))

    def stats(self) -> DataFrame:
        d = self.definition
        return self.live().agg(F.count(F.lit(1)).alias("doc_count")).select(F.lit(d.name).alias("store_name"), F.lit(d.dimension).alias("dimension"), "doc_count", F.lit(d.max_capacity).alias("max_capacity"), F.lit(d.metric).alias("metric"), F.lit(d.quantization).alias("quantization"))

    def page(self, page: int = 1, size: int = 20, vectors: bool = False) -> DataFrame:
        """Live rows in insertion order; page below 1 is 1, size below 1 is 20.  Vectors of a frozen store are dequantized."""
        page, size = max(page, 1), size if size > 0 else 20
        kept = ["id", "text", "metadata"]
        rows = self.live()
        if vectors:
            if self.params:
                rows = rows.withColumn("vector", sq8.dequantized(F.col("code"), self.params).cast("array<float>"))
            kept = ["id", "vector", "text", "metadata"]
        return rows.orderBy("seq").offset((page - 1) * size).limit(size).select(*kept)

    # ------------------------------------------------------------ mutations
    def upsert(self, batch: DataFrame, order: str = "batch_seq", base: int | None = None, others: int = 0) -> VectorStore:
        """Insert or fully replace by id; the last of a repeated id wins; ids keep their first position.

        Deleted ids come alive again.  Too many live rows raise before anything changes.  New ids go after
        ``base - 1``, by default the highest position.  ``others`` are live rows elsewhere that count for the
        capacity.  Only ids and positions of the store are looked up; rows that the batch doesn't have are
        neither grouped nor quantized again, and with a small batch they aren't shuffled.
        """
        d = self.definition
        if base is None:
            top = self.rows.agg(F.max("seq")).first()[0]
            base = 0 if top is None else top + 1
        new = _checked(_shaped(batch.withColumn("seq", F.col(order).cast("long") + base).withColumn("deleted", F.lit(False)), d), d)
        names = [f.name for f in d.schema() if f.name not in ("id", "seq")]
        latest = new.groupBy("id").agg(F.max_by(F.struct(*[quoted(n) for n in names]), "seq").alias("_row"), F.min("seq").alias("_new"))
        places = self.rows.select("id", F.col("seq").alias("_old")).join(latest.select("id"), "id", "left_semi")
        rows = latest.join(places, "id", "left").select("id", F.coalesce("_old", "_new").alias("seq"), *[F.col("_row").getField(n).alias(n) for n in names]).select(*[quoted(n) for n in d.schema().names])
        kept = self.rows.join(latest.select("id"), "id", "left_anti")
        if d.max_capacity > 0 and others + kept.where(~F.col("deleted")).count() + latest.where("_row.vector is not null").count() > d.max_capacity:
            raise ValueError(f"store {d.name} holds at most {d.max_capacity} documents")
        if self.params:
            rows = sq8.with_codes(rows, self.params)
        return replace(self, rows=kept.select(*[quoted(c) for c in rows.columns]).union(rows)).frozen_if_due()

    def delete_by_ids(self, ids: DataFrame | list[str] | None) -> tuple[VectorStore, int]:
        """The store without these ids, and how many live rows went; unknown and repeated ids count 0."""
        if ids is None or (isinstance(ids, list) and not ids):
            return self, 0
        spark = self.rows.sparkSession
        frame = spark.createDataFrame([(x,) for x in ids], "_id string") if isinstance(ids, list) else ids.select(F.col(ids.columns[0]).cast("string").alias("_id"))
        gone = self.rows.join(frame.where("_id is not null").distinct(), F.col("id") == F.col("_id"), "left")
        return self._flagged(gone, F.col("_id").isNotNull())

    def delete_by_filter(self, condition: Filter | None) -> tuple[VectorStore, int]:
        """The store without the rows that match, and how many went; no filter deletes nothing."""
        if condition is None:
            return self, 0
        return self._flagged(self.rows, condition.column(self.definition.indexed))

    def _flagged(self, rows: DataFrame, gone) -> tuple[VectorStore, int]:
        gone = F.coalesce(gone, F.lit(False))
        n = rows.where(~F.col("deleted") & gone).count()
        kept = [quoted(c) for c in rows.columns if c not in ("_id", "deleted")]
        return replace(self, rows=rows.select(*kept, (F.col("deleted") | gone).alias("deleted")).select(*[quoted(c) for c in self.rows.columns])), n

    def compacted(self) -> VectorStore:
        return replace(self, rows=self.live())

    # ------------------------------------------------------------ quantization
    def frozen_if_due(self) -> VectorStore:
        """Freezes SQ8 parameters once the store has enough rows; they never change afterwards."""
        d = self.definition
        if d.quantization != "SQ8" or self.params is not None:
            return self
        target = sq8.freeze_target(d.max_capacity, d.freeze_rows)
        if self.rows.select("id").limit(target).count() < target:
            return self
        params = sq8.freeze(self.rows, target)
        return replace(self, rows=sq8.with_codes(self.rows, params), params=params)

    def with_norms(self) -> VectorStore:
        """A Float32 cosine store that keeps its vectors' norms."""
        return replace(self, rows=self.rows.withColumn("norm", norm(F.col("vector"))))


def _shaped(docs: DataFrame, d: StoreDefinition) -> DataFrame:
    """Documents in the store's columns."""
    have = set(docs.columns)
    metadata = F.col("metadata") if "metadata" in have else F.lit(None).cast("variant")
    out = [F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("vector").cast("array<float>").alias("vector"), (F.col("text").cast("string") if "text" in have else F.lit(None).cast("string")).alias("text"), metadata.alias("metadata")]
    for name, kind in d.indexed.items():
        out.append((quoted(name).cast(kind) if name in have else F.try_variant_get("metadata", f"$['{name}']", kind)).alias(name))
    return docs.select(*out, F.col("deleted").cast("boolean").alias("deleted"))
