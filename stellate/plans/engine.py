"""The engine: named stores, their snapshots and the embedding models they are bound to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.embedding import Model, Registry, embed_missing
from ..operators import search
from ..operators.filters import Filter
from ..sources.snapshot import NoStorage, SnapshotStorage
from ..store import VectorStore
from .definition import StoreDefinition


class Engine:
    """Registry of stores; a store's version changes only here."""

    def __init__(self, spark: SparkSession, storage: SnapshotStorage | NoStorage | None = None, registry: Registry | None = None):
        self.spark, self.storage, self.registry = spark, storage or NoStorage(), registry or Registry()
        self._stores: dict[str, VectorStore] = {}
        self._saved: dict[str, tuple[VectorStore, int]] = {}  # what was loaded last, and from which version

    @staticmethod
    def from_config(spark: SparkSession, config: dict, providers: dict | None = None) -> Engine:
        """``{"snapshot_root", "models": [..], "stores": [..]}``: creates each store and loads its snapshot."""
        storage = SnapshotStorage(spark, config["snapshot_root"]) if config.get("snapshot_root") else NoStorage()
        engine = Engine(spark, storage, Registry([Model(**m) for m in config.get("models", [])], providers))
        for s in config.get("stores", []):
            engine.create_store(s["name"], StoreDefinition(**s))
            engine.reload(s["name"])
        return engine

    # ------------------------------------------------------------ stores
    def create_store(self, name: str, definition: StoreDefinition) -> VectorStore:
        """A new store; an existing one with the same embedding binding is returned as it is."""
        if not name or definition is None:
            raise ValueError("a store needs a name and a definition")
        d = definition.renamed(name=name)
        if d.embedding_model is not None:
            self.registry.validate(d.embedding_model)
            d = d.renamed(embedding_version=self.registry.version(d.embedding_model, d.embedding_version))
        old = self._stores.get(name)
        if old is not None:
            if (old.definition.embedding_model, old.definition.embedding_version) != (d.embedding_model, d.embedding_version):
                raise ValueError(f"store {name} is bound to {old.definition.embedding_model} {old.definition.embedding_version}")
            return old
        self._stores[name] = VectorStore.empty(self.spark, d)
        return self._stores[name]

    def has_store(self, name: str | None) -> bool:
        return name is not None and name in self._stores

    def list_stores(self) -> list[str]:
        return sorted(self._stores)

    def get_store(self, name: str | None) -> VectorStore:
        if name is None or name not in self._stores:
            raise ValueError(f"no store {name!r}")
        return self._stores[name]

    def put(self, store: VectorStore) -> VectorStore:
        """Make a version of a store the current one."""
        self._stores[store.definition.name] = store
        return store

    def drop_store(self, name: str, purge: bool = False) -> None:
        """Forget a store; its snapshot stays unless purged; unknown names are no error."""
        self._stores.pop(name, None)
        self._saved.pop(name, None)
        if purge:
            self.storage.delete(name)

    def reset(self, name: str) -> None:
        self.put(VectorStore.empty(self.spark, self.get_store(name).definition))

    def stats(self, name: str) -> DataFrame:
        return self.get_store(name).stats()

    def list_documents(self, name: str, page: int = 1, size: int = 20, vectors: bool = False) -> dict:
        store = self.get_store(name)
        return {"items": store.page(page, size, vectors), "page": max(page, 1), "size": size if size > 0 else 20, "total": store.live().count()}

    # ------------------------------------------------------------ mutations
    def upsert(self, name: str, batch: DataFrame, order: str = "batch_seq") -> VectorStore:
        """Upsert; documents with a text and no vector are embedded by the store's bound model first.

        With a snapshot storage the change is saved at once and read back, so lineage stays short: only the
        buckets of the batch's ids are written, unless the store differs from its snapshot.
        """
        store = self.get_store(name)
        d = store.definition
        if "vector" not in batch.columns:
            batch = batch.selectExpr("*", "cast(null as array<float>) as vector")
        if "text" in batch.columns and batch.where("vector is null").limit(1).count():
            if batch.where("vector is null and text is null").limit(1).count():
                raise ValueError("a document needs a vector or a text")
            if d.embedding_model is None:
                raise RuntimeError(f"store {name} is bound to no embedding model")
            model = self.registry.resolve(d.embedding_model)
            batch = embed_missing(batch, self.registry.provider(model.name), model.name, d.embedding_version or model.version, model.batch_size)
        if self._is_saved(name):
            self.storage.upsert(d, batch, order)
            self.reload(name)
            return self.get_store(name)
        self.put(store.upsert(batch, order))
        return self._settled(name)

    def delete_by_ids(self, name: str, ids: DataFrame | list[str] | None) -> int:
        return self._delete(name, "delete_by_ids", ids)

    def delete_by_filter(self, name: str, condition: Filter | None) -> int:
        return self._delete(name, "delete_by_filter", condition)

    def _delete(self, name: str, how: str, what) -> int:
        """Deletions are saved like upserts."""
        store = self.get_store(name)
        if self._is_saved(name):
            n = getattr(self.storage, how)(store.definition, what)
            self.reload(name)
            return n
        store, n = getattr(store, how)(what)
        self.put(store)
        self._settled(name)
        return n

    def _is_saved(self, name: str) -> bool:
        """Whether the store is, unchanged, the current version of its snapshot."""
        loaded, number = self._saved.get(name, (None, 0))
        return loaded is not None and loaded is self._stores.get(name) and (self.storage.current(name) or {}).get("number") == number

    def _settled(self, name: str) -> VectorStore:
        if isinstance(self.storage, SnapshotStorage):
            self.refresh(name)
            self.reload(name)
        return self.get_store(name)

    # ------------------------------------------------------------ search
    def search(self, name: str, mode: str = "VECTOR", vector: list[float] | None = None, text: str | None = None, **kwargs) -> DataFrame:
        """Search in the given mode: VECTOR, TEXT or HYBRID."""
        store = self.get_store(name)
        if mode == "TEXT":
            return search.search_by_text(store, text, self.registry, **kwargs)
        if mode == "HYBRID":
            return search.hybrid_search(store, vector, text, self.registry, **kwargs)
        return search.search_by_vector(store, vector, **kwargs)

    def search_batch(self, name: str, queries: DataFrame, **kwargs) -> DataFrame:
        return search.search_batch(self.get_store(name), queries, **kwargs)

    # ------------------------------------------------------------ snapshots
    def refresh(self, name: str) -> None:
        """Save the store now."""
        self.storage.save(self.get_store(name))

    def reload(self, name: str) -> None:
        """Load the store's snapshot; without one the store stays as it is."""
        found = self.storage.load(self.get_store(name).definition)
        if found is not None:
            self.put(found)
            if (found.params is not None) == self.storage.current(name)["frozen"]:  # not frozen while it was read
                self._saved[name] = found, self.storage.current(name)["number"]
