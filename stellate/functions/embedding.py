"""Text embedding through a pluggable provider, in bounded chunks inside Arrow batches."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


class Provider(Protocol):
    """Embeds texts.  Calls run inside tasks and may repeat when a task does, so they must be idempotent."""

    def embed(self, model: str, version: str, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Model:
    """A model of the registry."""

    name: str
    version: str = "1"
    provider: str = "http"
    url: str | None = None
    timeout_s: float = 1.0
    batch_size: int = 8
    is_default: bool = False


class CharacterProvider:
    """Deterministic provider for tests: component i is the code of character i mod length, mod 26, over 26."""

    def __init__(self, dimension: int = 8):
        self.dimension = dimension

    def embed(self, model: str, version: str, texts: list[str]) -> list[list[float]]:
        return [[(ord(t[i % len(t)]) % 26) / 26.0 if t else 0.0 for i in range(self.dimension)] for t in texts]


def character_vector(text: Column, dimension: int = 8) -> Column:
    """The same rule as an expression."""
    n = F.char_length(text)
    one = lambda i: F.when(n == 0, F.lit(0.0)).otherwise((F.ascii(F.substring(text, (i % F.greatest(n, F.lit(1))) + 1, F.lit(1))) % 26) / F.lit(26.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), one).cast("array<float>")


@dataclass(frozen=True)
class HttpProvider:
    """POSTs ``{model, version, input}`` and reads any of the usual response shapes."""

    url: str
    timeout_s: float = 1.0

    def embed(self, model: str, version: str, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "version": version, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
            return parse_response(json.load(answer))


def parse_response(answer) -> list[list[float]]:
    """Vectors of ``{data: [{embedding} or list]}``, ``{embedding: list}`` or a list of lists; else an error."""
    if isinstance(answer, dict) and isinstance(answer.get("data"), list):
        found = [x["embedding"] if isinstance(x, dict) else x for x in answer["data"]]
    elif isinstance(answer, dict) and isinstance(answer.get("embedding"), list):
        found = [answer["embedding"]]
    else:
        found = answer if isinstance(answer, list) and answer and all(isinstance(x, list) for x in answer) else []
    if not found:
        raise ValueError("the embedding response holds no vector")
    return [[float(v) for v in x] for x in found]


class Registry:
    """Models and providers: lookup, defaults, versions and binding rules."""

    def __init__(self, models: list[Model] = (), providers: dict[str, Provider] | None = None):
        self.models, self.providers = {m.name: m for m in models}, dict(providers or {})

    def list_models(self) -> list[Model]:
        return list(self.models.values())

    def has_model(self, name: str | None) -> bool:
        return name in self.models

    def resolve(self, name: str | None) -> Model:
        """The named model, else the default one, else an error."""
        if name is not None and name in self.models:
            return self.models[name]
        if name is None:
            for m in self.models.values():
                if m.is_default:
                    return m
        raise ValueError(f"no embedding model {name!r} and no default")

    def version(self, name: str, asked: str | None) -> str:
        return asked or self.resolve(name).version or "1"

    def provider(self, name: str) -> Provider:
        model = self.resolve(name)
        found = self.providers.get(model.provider)
        if found is None and model.provider == "http" and model.url:
            found = HttpProvider(model.url, model.timeout_s)
        if found is None:
            raise ValueError(f"no provider for the model {name!r}")
        return found

    def validate(self, name: str) -> None:
        self.provider(name)


def embed_chunks(provider: Provider, model: str, version: str, texts: list[str], chunk: int) -> list[list[float]]:
    """Vectors in the order of the texts, asked for ``chunk`` at a time; a wrong count is an error."""
    out: list[list[float]] = []
    for at in range(0, len(texts), chunk):
        some = texts[at : at + chunk]
        got = provider.embed(model, version, some)
        if len(got) != len(some):
            raise ValueError(f"{len(some)} texts gave {len(got)} vectors")
        out += got
    return out


def embed_missing(rows: DataFrame, provider: Provider, model: str, version: str, chunk: int = 8) -> DataFrame:
    """Fills null ``vector`` from ``text``; a vector that is there wins."""
    names = rows.columns
    v, t = names.index("vector"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, texts = batch.column(v).to_pylist(), batch.column(t).to_pylist()
            need = [k for k, x in enumerate(vectors) if x is None and texts[k] is not None]
            for k, x in zip(need, embed_chunks(provider, model, version, [texts[k] for k in need], chunk), strict=True):
                vectors[k] = x
            columns = list(batch.columns)
            columns[v] = pa.array(vectors, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)
