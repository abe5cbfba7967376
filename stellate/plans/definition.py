"""What a store is: immutable definition and its checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class StoreDefinition:
    """Name, dimension and rules of a store.

    ``indexed`` maps promoted metadata fields to Spark types.  A saved store is cut into ``buckets`` by a hash
    of the id; a change writes the buckets that it touches.
    """

    name: str
    dimension: int = 512
    metric: str = "COSINE"
    max_capacity: int = 100_000
    embedding_model: str | None = None
    embedding_version: str | None = None
    quantization: str = "NONE"
    indexed: dict[str, str] = field(default_factory=dict)
    freeze_rows: int = 1024
    buckets: int = 16

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a store needs a name")
        if self.dimension < 1:
            raise ValueError("the dimension must be positive")
        if self.buckets < 1:
            raise ValueError("a store needs a bucket")
        if self.quantization not in ("NONE", "SQ8"):
            raise ValueError(f"unknown quantization {self.quantization!r}")
        clash = {"id", "seq", "vector", "text", "metadata", "deleted", "code", "code_norm", "bucket"} & set(self.indexed)
        if clash:
            raise ValueError(f"indexed fields clash with the store's columns: {sorted(clash)}")

    def renamed(self, **changes) -> StoreDefinition:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> StoreDefinition:
        return StoreDefinition(**json.loads(text))

    def schema(self) -> T.StructType:
        s = T.StructType().add("id", "string").add("seq", "long").add("vector", T.ArrayType(T.FloatType())).add("text", "string").add("metadata", T.VariantType())
        for name, kind in self.indexed.items():
            s = s.add(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)
        return s.add("deleted", "boolean")
