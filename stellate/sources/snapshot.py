"""Versioned snapshots on any Hadoop file system: immutable version folders and a pointer that names the current one."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import sq8
from ..operators.filters import Filter
from ..plans.definition import StoreDefinition
from ..store import VectorStore, quoted


class SnapshotStorage:
    """Saves, loads and changes stores under ``root/<store name>``.

    A version is a map from buckets (of a hash of the id) to folders, with the number of live rows and the
    highest position.  A change reads and writes the buckets of the ids that it touches, and the version
    it makes shares all other folders with the one before.  ``pointer/<n>`` holds one text file per version;
    the highest one is current.  A version is complete before its pointer is written, so readers never see
    half of one.  A writer first claims the next number, by creating a file that must not exist, so two
    writers never lose a version; one that finds the number claimed raises.  The ``keep`` latest versions
    stay, older ones go with the folders that only they name.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(keep, 1)

    # ------------------------------------------------------------ files
    def _path(self, name: str, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, name, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        path, fs = self._path(name, "pointer")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def _pointer(self, name: str, number: int) -> dict:
        path, fs = self._path(name, "pointer", f"{number:012d}")
        file = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")) | {"number": number}
        finally:
            file.close()

    def current(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        return self._pointer(name, numbers[-1]) if numbers else None

    @contextmanager
    def _claimed(self, name: str, number: int):
        """The exclusive right to write version ``number``, given back if the writing fails."""
        path, fs = self._path(name, "pointer", f"{number:012d}.claim")
        try:
            fs.create(path, False).close()
        except Py4JJavaError as taken:
            raise RuntimeError(f"another writer saves version {number} of {name}; if it has died, remove {path}") from taken
        try:
            if self._numbers(name)[-1:] not in ([], [number - 1]):
                raise RuntimeError(f"another writer has saved version {number} of {name}")
            yield
        except BaseException:
            fs.delete(path, False)
            raise

    def _publish(self, name: str, number: int, version: dict) -> None:
        final, fs = self._path(name, "pointer", f"{number:012d}")
        part, _ = self._path(name, "pointer", f"{number:012d}.part-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not fs.rename(part, final):
            raise RuntimeError(f"version {number} of {name} was not published")
        numbers = self._numbers(name)
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        if old:
            folders = lambda ns: {f for n in ns for p in [self._pointer(name, n)] for f in [*p["buckets"].values(), p["params"]] if f}
            for folder in folders(old) - folders(kept):
                fs.delete(self._path(name, folder)[0], True)
            for n in old:
                for file in (f"{n:012d}", f"{n:012d}.claim"):
                    fs.delete(self._path(name, "pointer", file)[0], False)

    # ------------------------------------------------------------ whole versions
    def save(self, store: VectorStore) -> int:
        """Write the live rows as a new version and point at it; returns its number."""
        d = store.definition
        before = self.current(d.name)
        number = (before["number"] if before else 0) + 1
        with self._claimed(d.name, number):
            folder = f"v-{uuid.uuid4().hex}"
            found = self._written(store.live(), d, folder)
            if store.params:
                store.params.as_rows(self.spark).coalesce(1).write.parquet(f"{self.root}/{d.name}/{folder}/params")
            version = {"definition": json.loads(d.to_json()), "frozen": store.params is not None, "params": folder if store.params else None, **found}
            self._publish(d.name, number, version)
        return number

    def _written(self, rows: DataFrame, d: StoreDefinition, folder: str) -> dict:
        """Write rows by bucket; the map of the buckets that have rows, their live rows and highest position."""
        at = f"{self.root}/{d.name}/{folder}/rows"
        # Ranges of (bucket, position): a large bucket is many files, a small one is one.
        rows.withColumn("bucket", _bucket(F.col("id"), d.buckets)).repartitionByRange("bucket", "seq").sortWithinPartitions("bucket", "seq").write.partitionBy("bucket").parquet(at)
        path, fs = self._path(d.name, folder, "rows")
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        buckets = {n.partition("=")[2]: folder for n in names if n.startswith("bucket=")}  # at most the definition's number
        if not buckets:
            return {"buckets": {}, "count": 0, "top": None, "schema": rows.schema.json()}
        n, top = self.spark.read.schema(rows.schema).parquet(at).agg(F.count_if(~F.col("deleted")), F.max("seq")).first()
        return {"buckets": buckets, "count": n, "top": top, "schema": rows.schema.json()}

    def load(self, definition: StoreDefinition) -> VectorStore | None:
        """The saved store, or None if there is none.

        Dimension, metric and quantization must agree, which is checked before anything else; a Float32
        snapshot may go into an SQ8 store, where calibration starts again.  Codes are read as they are.
        """
        found = self.current(definition.name)
        return None if found is None else self._loaded(definition, found)

    def _loaded(self, definition: StoreDefinition, found: dict, buckets: list[str] | None = None) -> VectorStore:
        """The store of a version, or of some of its buckets."""
        saved = StoreDefinition.from_json(json.dumps(found["definition"]))
        if saved.dimension != definition.dimension or saved.metric != definition.metric:
            raise ValueError(f"the snapshot has {saved.dimension} dimensions and metric {saved.metric}")
        if found["frozen"] and definition.quantization != "SQ8":
            raise ValueError("the snapshot is quantized, the store is not")
        paths = [f"{self.root}/{definition.name}/{v}/rows/bucket={k}" for k, v in sorted(found["buckets"].items()) if buckets is None or k in buckets]
        params = None
        if found["frozen"]:
            some = sorted(self.spark.read.parquet(f"{self.root}/{definition.name}/{found['params']}/params").collect())
            params = sq8.Params(tuple(r["min"] for r in some), tuple(r["scale"] for r in some))
        if not paths:
            rows = self.spark.createDataFrame([], definition.schema())
            return VectorStore(definition, sq8.with_codes(rows, params) if params else rows, params)
        rows = self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(*paths)
        for c in definition.schema().names:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.try_variant_get("metadata", f"$['{c}']", definition.indexed[c]))
        names = [quoted(c) for c in definition.schema().names]
        if params is None:
            store = VectorStore(definition, rows.select(*names))
            return store if buckets is not None else store.frozen_if_due()
        return VectorStore(definition, rows.select(*names, "code", "code_norm"), params)

    # ------------------------------------------------------------ changes
    def upsert(self, definition: StoreDefinition, batch: DataFrame, order: str = "batch_seq") -> None:
        """:meth:`VectorStore.upsert` into the saved store: reads and writes only the buckets of the batch's ids."""
        found = self._same(definition)
        with self._claimed(definition.name, found["number"] + 1):
            folder = f"v-{uuid.uuid4().hex}"
            at = f"{self.root}/{definition.name}/{folder}/batch"
            batch.write.parquet(at)  # made once: its plan may embed texts
            batch = self.spark.read.parquet(at)
            store, touched = self._touched(definition, found, batch.select(F.col("id").cast("string").alias("id")))
            if not found["frozen"]:  # a part of a store must not calibrate
                store = replace(store, definition=definition.renamed(quantization="NONE"))
            before = store.live().count()
            new = store.upsert(batch, order, 0 if found["top"] is None else found["top"] + 1, found["count"] - before)
            self._replaced(definition, found, new, touched, before, folder)
            self._path(definition.name)[1].delete(self._path(definition.name, folder, "batch")[0], True)
        if definition.quantization == "SQ8" and not found["frozen"]:
            whole = self.load(definition)
            if whole.params is not None:  # frozen now, once: all rows get codes
                self.save(whole)

    def delete_by_ids(self, definition: StoreDefinition, ids: DataFrame | list[str] | None) -> int:
        """Deletes from the saved store; reads and writes only the buckets of the ids.  Returns how many live rows went."""
        if ids is None or (isinstance(ids, list) and not ids):
            return 0
        frame = self.spark.createDataFrame([(x,) for x in ids], "id string") if isinstance(ids, list) else ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
        return self._deleted(definition, frame.where("id is not null"), lambda s: s.delete_by_ids(frame))

    def delete_by_filter(self, definition: StoreDefinition, condition: Filter | None) -> int:
        """Deletes what matches; buckets without a match are read for the condition's columns only and stay as they are."""
        if condition is None:
            return 0
        matching = self.load(definition).live().where(condition.column(definition.indexed)).select("id")
        return self._deleted(definition, matching, lambda s: s.delete_by_filter(condition))

    def _deleted(self, definition: StoreDefinition, ids: DataFrame, change) -> int:
        found = self._same(definition)
        with self._claimed(definition.name, found["number"] + 1):
            store, touched = self._touched(definition, found, ids)
            new, n = change(store)
            self._replaced(definition, found, new, touched, store.live().count(), f"v-{uuid.uuid4().hex}")
        return n

    def _same(self, definition: StoreDefinition) -> dict:
        found = self.current(definition.name)
        if found is None or found["definition"] != json.loads(definition.to_json()):
            raise ValueError(f"{definition.name} is not saved with this definition")
        return found

    def _touched(self, d: StoreDefinition, found: dict, ids: DataFrame) -> tuple[VectorStore, list[str]]:
        """The part of the store in the buckets of these ids, and the buckets: at most the definition's number of them."""
        touched = [str(r[0]) for r in ids.select(_bucket(F.col("id"), d.buckets)).distinct().collect() if r[0] is not None]
        return self._loaded(d, found, touched), touched

    def _replaced(self, d: StoreDefinition, found: dict, store: VectorStore, touched: list[str], before: int, folder: str) -> None:
        new = self._written(store.rows, d, folder)
        buckets = {k: v for k, v in found["buckets"].items() if k not in touched} | new["buckets"]
        tops = [t for t in (found["top"], new["top"]) if t is not None]
        kept = {k: found[k] for k in ("definition", "frozen", "params")}
        self._publish(d.name, found["number"] + 1, kept | {"buckets": buckets, "count": found["count"] - before + new["count"], "top": max(tops, default=None), "schema": new["schema"]})

    def delete(self, name: str) -> None:
        """Remove every version of a store."""
        path, fs = self._path(name)
        fs.delete(path, True)


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


class NoStorage:
    """Keeps nothing."""

    def save(self, store: VectorStore) -> None:
        return None

    def load(self, definition: StoreDefinition) -> None:
        return None

    def delete(self, name: str) -> None:
        return None


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Bulk import: JSON array or lines of ``id, vector, text, metadata``; ``metadata`` becomes a variant."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))).alias("j"))
    parsed = rows.select(F.from_json("j", "id string, vector array<float>, text string").alias("d"), F.get_json_object("j", "$.metadata").alias("m"))
    return parsed.select("d.id", "d.vector", "d.text", F.try_parse_json("m").alias("metadata"))


def demo_documents(spark: SparkSession, rows: int = 20, dimension: int = 128, seed: int = 1) -> DataFrame:
    """Random unit vectors with a category and a level, for demonstrations."""
    raw = spark.range(rows).select("id", F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: F.xxhash64("id", i, F.lit(seed)) / F.lit(2.0**63)).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = raw.withColumn("vector", F.transform("v", lambda x: x / length).cast("array<float>"))
    category = F.element_at(F.array(F.lit("tech"), F.lit("news"), F.lit("ai")), (F.col("id") % 3 + 1).cast("int"))
    return unit.select(F.concat(F.lit("demo-"), F.col("id")).alias("id"), F.col("id").alias("seq"), "vector", F.concat(F.lit("document "), F.col("id")).alias("text"), F.parse_json(F.to_json(F.struct(category.alias("category"), (F.col("id") % 5).alias("level")))).alias("metadata"))
