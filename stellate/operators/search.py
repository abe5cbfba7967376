"""Exact top-k search: one query as an ordered limit, many queries as blocks that tasks read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sq8
from ..functions.embedding import Registry, embed_chunks
from ..functions.vectors import COSINE, DOT_PRODUCT, lower_is_better, metric_of, score
from ..sources.shared import opened, shared_folder
from ..store import VectorStore
from .filters import Filter

#: Bytes of the query vectors of one block, and of the store's vectors that a task holds at once.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 64 << 20
#: Most queries that a task scores at once, and their candidates.
MOST_QUERIES, MOST_CANDIDATES = 1024, 1 << 20
#: Most winners whose payload is fetched by their positions.
FETCHED = 10_000


def _query(store: VectorStore, vector: list[float] | None) -> list[float]:
    if vector is None or len(vector) != store.definition.dimension:
        raise ValueError(f"a query of {store.definition.dimension} numbers is needed, not {0 if vector is None else len(vector)}")
    return [float(x) for x in vector]


def candidates(store: VectorStore, condition: Filter | None) -> DataFrame:
    """Live rows that match, before anything is scored."""
    rows = store.live()
    return rows if condition is None else rows.where(condition.column(store.definition.indexed))


def scored(store: VectorStore, vector: list[float], condition: Filter | None = None) -> DataFrame:
    """Candidates with ``score``: over codes once SQ8 is frozen, else over the vectors."""
    q = _query(store, vector)
    rows = candidates(store, condition)
    if store.params:
        return rows.withColumn("score", sq8.code_score(store.definition.metric, F.col("code"), F.col("code_norm"), q, store.params))
    length = sum(x * x for x in q) ** 0.5  # once, not per row
    return rows.withColumn("score", score(store.definition.metric, F.col("vector"), F.lit(q), F.lit(length)))


def _thresholded(rows: DataFrame, metric: str, min_score: float | None) -> DataFrame:
    if min_score is None:
        return rows
    return rows.where(F.col("score") <= min_score if lower_is_better(metric) else F.col("score") >= min_score)


def search_by_vector(store: VectorStore, vector: list[float], top_k: int | None = 10, min_score: float | None = None, condition: Filter | None = None, payload: bool = True) -> DataFrame:
    """``id, seq, score[, text, metadata]`` of the best ``top_k`` (at least 1), best first; ties by ``seq``.

    ``min_score`` is a lower bound, for Euclidean an upper one.  Without a ``top_k`` (None) all rows come.
    The scan that scores reads no text and no metadata; with ``payload`` these are fetched for the winners,
    for which the search runs at once.
    """
    metric = metric_of(store.definition.metric)
    rows = _thresholded(scored(store, vector, condition), metric, min_score)
    order = F.col("score").asc() if lower_is_better(metric) else F.col("score").desc()
    if top_k is None:
        return rows.select("id", "seq", "score", *(["text", "metadata"] if payload else [])).orderBy(order, "seq")
    hits = rows.select("id", "seq", "score").orderBy(order, "seq").limit(max(top_k, 1))
    return with_payload(hits, store).orderBy(order, "seq") if payload else hits


def with_payload(hits: DataFrame, store: VectorStore) -> DataFrame:
    """Hits with text and metadata of the winners.

    Up to ``FETCHED`` winners are looked up by their positions, a filter that the scan takes, so it skips
    all row groups without one; more are joined.
    """
    found = hits.limit(FETCHED + 1).collect()
    payload = store.rows.select("id", "seq", "text", "metadata")
    if len(found) > FETCHED:
        return hits.join(payload.drop("seq"), "id")
    winners = hits.sparkSession.createDataFrame(found, hits.schema)
    return winners.join(payload.where(F.col("seq").isin([r["seq"] for r in found])).drop("seq"), "id")


def search_by_text(store: VectorStore, text: str, registry: Registry, **kwargs) -> DataFrame:
    """Embed with the store's bound model and version, else the default model, then search."""
    d = store.definition
    model = registry.resolve(d.embedding_model)
    version = d.embedding_version or registry.version(model.name, None)
    vector = embed_chunks(registry.provider(model.name), model.name, version, [text], model.batch_size)[0]
    return search_by_vector(store, vector, **kwargs)


def hybrid_search(store: VectorStore, vector: list[float] | None = None, text: str | None = None, registry: Registry | None = None, **kwargs) -> DataFrame:
    """Vector search if there is a vector, else text search."""
    if vector is None and text is not None:
        return search_by_text(store, text, registry, **kwargs)
    return search_by_vector(store, vector, **kwargs)


def search_batch(store: VectorStore, queries: DataFrame, top_k: int = 10, min_score: float | None = None, condition: Filter | None = None) -> DataFrame:
    """``query_id, rank, id, seq, score`` for every row of ``queries`` (``query_id, vector``).

    Up to ``BLOCK_BYTES`` of queries go to the tasks with their code.  More are written in blocks of so many
    bytes to the shared folder, from where tasks read them one at a time; of these the driver sees the names
    of the files only.  A task holds a bounded chunk of the store, scores it against ``MOST_QUERIES`` of each
    block at a time by float32 products, and scores again, in double, what these can't tell from the best ``top_k``.  Each chunk gives
    at most ``top_k`` rows a query, ties by ``seq``; a window ranks them.  Rows of ``queries`` that share a
    ``query_id`` are queries of their own.
    """
    d = store.definition
    top_k, metric = max(top_k, 1), metric_of(d.metric)
    rows = candidates(store, condition).select("id", "seq", F.col("code" if store.params else "vector").alias("vector"))
    run = _scorer(query_blocks(queries, d.dimension), metric, d.dimension, top_k, min_score, store.params)
    out = rows.mapInArrow(run, "query long, query_id string, id string, seq long, score double")
    order = F.col("score").asc() if lower_is_better(metric) else F.col("score").desc()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "seq")))
    return ranked.where(F.col("rank") <= top_k).select("query_id", "rank", "id", "seq", "score")


Block = tuple[np.ndarray, pa.Array, np.ndarray]  # numbers, names and vectors of queries


def _block(first: int, names: pa.Array, lists: pa.Array, dimension: int) -> Block:
    """A block of queries with numbers from ``first``; raises on a vector of another length."""
    lists = lists.cast(pa.list_(pa.float64()))
    wrong = pc.fill_null(pc.not_equal(pc.list_value_length(lists), dimension), True)
    if pc.any(wrong).as_py():
        raise ValueError(f"query {names.filter(wrong)[0]}: {dimension} numbers are needed")
    return np.arange(first, first + len(names)), names, np.asarray(lists.flatten()).reshape(-1, dimension)


def query_blocks(queries: DataFrame, dimension: int) -> list[Block] | list[str]:
    """The one block of the queries, or the files of several."""
    spark = queries.sparkSession
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    most = max(1, BLOCK_BYTES // (8 * dimension))
    few = queries.limit(most + 1).toArrow().combine_chunks()  # one block and a row at most
    if len(few) <= most:
        return [_block(0, few.column(0).combine_chunks(), few.column(1).combine_chunks(), dimension)] if len(few) else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                _, names, vectors = _block(first, batch.column(0)[at : at + most], batch.column(1)[at : at + most], dimension)
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "names": pa.array([names.to_pylist()], pa.list_(pa.string())), "vectors": pa.array([vectors.tobytes()], pa.binary())})
                first += len(names)

    folder = shared_folder(spark, "queries")
    packed = queries.repartition(max(1, -(-queries.count() // most))).mapInArrow(pack, "first long, names array<string>, vectors binary")
    packed.write.option("parquet.block.size", BLOCK_BYTES).parquet(folder)
    return sorted(spark.read.parquet(folder).inputFiles())


def _scorer(queries: list[Block] | list[str], metric: str, dimension: int, top_k: int, min_score: float | None, params: sq8.Params | None):
    def blocks() -> Iterator[Block]:
        for source in queries:
            if not isinstance(source, str):
                yield source
                continue
            with opened(source) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=1, columns=["first", "names", "vectors"]):
                    for first, names, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        yield np.arange(first, first + len(names)), pa.array(names, pa.string()), np.frombuffer(raw, float).reshape(-1, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, seq = table.column(0).chunk(0), np.asarray(table.column(1).chunk(0))
            v = np.asarray(table.column(2).chunk(0).flatten()).reshape(len(seq), dimension)
            for numbers, names, q in blocks():
                a, b, score = best_of(q, v, seq, metric, top_k, min_score, params=params)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[a]), names.take(pa.array(a)), ids.take(pa.array(b)), pa.array(seq[b]), pa.array(score)], names=["query", "query_id", "id", "seq", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * dimension * 4
            if size >= CHUNK_BYTES:
                yield from chunk()
                size = 0
        if held:
            yield from chunk()

    return run


def exact_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores in double of pairs of rows (or of one row with all)."""
    v = v.astype(float)
    if metric == DOT_PRODUCT:
        return (q * v).sum(axis=-1)
    if metric != COSINE:
        return np.sqrt(((q - v) ** 2).sum(axis=-1))
    length = np.sqrt((q * q).sum(axis=-1)) * np.sqrt((v * v).sum(axis=-1))
    return np.where(length == 0, 0.0, (q * v).sum(axis=-1) / np.where(length == 0, 1.0, length))


def best_of(q: np.ndarray, v: np.ndarray, seq: np.ndarray, metric: str, top_k: int, min_score: float | None = None, step: int = 4096, params: sq8.Params | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and score of the best ``top_k`` rows of ``v`` (with ``params``: of codes) for each query, ties by ``seq``.

    Rows are met ``step`` at a time by products in float32, whose error is bounded: what is within the bound
    of the ``top_k``-th best so far is a candidate, and candidates are scored in double.  Where very many
    rows tie, the query is scored in double as a whole, so candidates stay few.  Equal queries are scored
    once, and a bounded number of queries at a time.
    """
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(one.tobytes(), len(seen)) for one in q], np.int64)
    if len(seen) < len(q):
        x, y, score = best_of(q[np.unique(which, return_index=True)[1]], v, seq, metric, top_k, min_score, step, params)
        first = np.searchsorted(x, np.arange(len(seen) + 1))
        count = np.diff(first)[which]
        at = np.arange(count.sum()) + np.repeat(first[which] - (np.cumsum(count) - count), count)
        return np.repeat(np.arange(len(q)), count), y[at], score[at]
    n, dimension = len(v), q.shape[1]
    b, v_len = np.empty((n, dimension), np.float32), np.empty(n)
    for at in range(0, n, step):
        part = b[at : at + step]
        part[:] = _doubles(v[at : at + step], params)
        length = v_len[at : at + step] = np.sqrt(np.einsum("ij,ij->i", part, part, dtype=float))
        if metric == COSINE:
            part /= np.where(length == 0, 1, length)[:, None]
    few = max(1, min(MOST_QUERIES, MOST_CANDIDATES // _candidates(top_k)))
    parts = [(x + at, y, score) for at in range(0, len(q), few) for x, y, score in [_best_of_few(q[at : at + few], v, b, v_len, seq, metric, top_k, min_score, step, params)]]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _doubles(v: np.ndarray, params: sq8.Params | None) -> np.ndarray:
    """Vectors in double, of codes the dequantized ones."""
    return np.array(params.low) + np.array(params.scale) * (v.astype(float) + 128) if params else v.astype(float)


def _candidates(top_k: int) -> int:
    """Most candidates of a query, beyond which it is scored as a whole."""
    return 16 * top_k + 256


def _best_of_few(q: np.ndarray, v: np.ndarray, b: np.ndarray, v_len: np.ndarray, seq: np.ndarray, metric: str, top_k: int, min_score: float | None, step: int, params: sq8.Params | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_of`` for distinct queries whose products with ``step`` rows are held at once.

    ``b`` are the vectors in float32, for cosine of length 1, ``v_len`` their lengths.
    """
    n_q, n = len(q), len(v)
    way = 1.0 if metric in (COSINE, DOT_PRODUCT) else -1.0  # times the score: greater is better
    a, q_len = q.astype(np.float32), np.sqrt((q * q).sum(axis=1))
    unit = (q.shape[1] + 16) * 2.0**-23  # twice the usual bound of a product's relative error
    offset = None
    if metric == COSINE:
        a = (a / np.where(q_len == 0, 1, q_len)[:, None]).astype(np.float32)
        error = np.full(n_q, unit)
    elif metric == DOT_PRODUCT:
        error = unit * q_len * v_len.max()
    else:  # less distance is a greater product less half of the squared length
        offset = (v_len**2 / 2).astype(np.float32)
        error = unit * (q_len * v_len.max() + v_len.max() ** 2)
    edge = np.full(n_q, -np.inf)
    top = np.full((n_q, top_k), -np.inf, np.float32)
    tied = np.zeros(n_q, bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, most = 0, _candidates(top_k)
    for at in range(0, n, step):
        s = a @ b[at : at + step].T
        if offset is not None:
            s -= offset[at : at + step]
        if at == 0 and s.shape[1] > top_k:
            edge = np.partition(s, s.shape[1] - top_k, axis=1)[:, s.shape[1] - top_k] - 2 * error
        edge[tied] = np.inf
        hit = s >= np.nextafter(edge.astype(np.float32), np.float32(-np.inf))[:, None]
        hit[tied] = False
        many = hit.sum(axis=1) > most
        if many.any() and s.shape[1] > top_k:
            tied |= many
            hit[many] = False
        x, y = np.nonzero(hit)
        value = s[x, y]
        found.append((x, y + at, value))
        size += len(x)
        rows = np.concatenate([np.repeat(np.arange(n_q), top_k), x])
        values = np.concatenate([top.ravel(), value])
        order = np.lexsort((-values, rows))
        first = np.searchsorted(rows[order], np.arange(n_q))
        top = values[order][first[:, None] + np.arange(top_k)[None, :]]
        edge = top[:, -1].astype(float) - 2 * error
        if size > n_q * most:  # candidates that better ones have left behind go
            x, y, value = (np.concatenate([f[k] for f in found]) for k in range(3))
            keep = value >= edge[x]
            tied |= np.bincount(x[keep], minlength=n_q) > most
            keep &= ~tied[x]
            found, size = [(x[keep], y[keep], value[keep])], int(keep.sum())
    x, y, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    keep = (value >= edge[x]) & ~tied[x]
    x, y = x[keep], y[keep]
    pairs = max(1, (1 << 19) // q.shape[1])
    score = np.concatenate([exact_scores(q[x[k : k + pairs]], _doubles(v[y[k : k + pairs]], params), metric) for k in range(0, len(x), pairs)] or [np.zeros(0)])
    parts = [(x, y, score)]
    for k in np.flatnonzero(tied):
        one = np.concatenate([exact_scores(q[k], _doubles(v[at : at + pairs], params), metric) for at in range(0, n, pairs)])
        best = np.lexsort((seq, -way * one))[:top_k]
        parts.append((np.full(len(best), k), best, one[best]))
    x, y, score = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if min_score is not None:
        good = way * score >= way * min_score
        x, y, score = x[good], y[good], score[good]
    order = np.lexsort((seq[y], -way * score, x))
    x, y, score = x[order], y[order], score[order]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    return x[place < top_k], y[place < top_k], score[place < top_k]


def search_reranked(store: VectorStore, vector: list[float], top_k: int = 10, factor: int = 5, condition: Filter | None = None) -> DataFrame:
    """Top ``top_k * factor`` over codes, then exact scores of these (kept Float32 vectors) and top-k.

    The first scan reads codes only; up to ``FETCHED`` of its rows are then read by position.
    """
    coarse = search_by_vector(store, vector, max(top_k, 1) * factor, condition=condition, payload=False)
    q = _query(store, vector)
    metric = metric_of(store.definition.metric)
    few = max(top_k, 1) * factor <= FETCHED
    rows = store.rows.where(F.col("seq").isin([r["seq"] for r in coarse.collect()])) if few else store.rows.join(coarse.select("id"), "id", "left_semi")
    exact = rows.select("id", "seq", score(metric, F.col("vector"), F.lit(q)).alias("score"))
    order = F.col("score").asc() if lower_is_better(metric) else F.col("score").desc()
    return exact.select("id", "seq", "score").orderBy(order, "seq").limit(max(top_k, 1))


def search_metrics(hits: DataFrame) -> DataFrame:
    """Hit count, best and worst score of a result."""
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
