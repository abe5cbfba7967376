"""The query catalogue of the vector store, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import sq8, vectors
from .functions.embedding import CharacterProvider, Model, Registry, character_vector
from .operators import filters as f, search
from .operators.ivf import IvfIndex
from .plans.definition import StoreDefinition
from .plans.engine import Engine
from .sources.shared import shared_folder
from .sources.snapshot import SnapshotStorage, read_documents_json
from .store import VectorStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- stores
def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _emb(spark: SparkSession, d: str, metric: str = "COSINE", kind: str = "plain", **more) -> VectorStore:
    v = F.col("embedding")
    if kind == "scaled":
        v = F.transform(v, lambda x: x * (1 + F.col("label")).cast("float"))
    elif kind == "zero":
        v = F.when(F.col("vec_id") % 50 == 0, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v)
    docs = _table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), v.alias("vector"), "label")
    return VectorStore.from_documents(docs, StoreDefinition(f"emb_{kind}", 64, metric, 10**9, indexed={"label": "int"}, **more))


def _order_vec(spark: SparkSession, d: str, metric: str = "EUCLIDEAN", **more) -> VectorStore:
    day, rank = F.dayofmonth("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    v = F.array(F.col("o_totalprice") / 1000, F.month("o_orderdate"), day, rank.cast("double")).cast("array<float>")
    docs = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), v.alias("vector"), "o_orderstatus")
    return VectorStore.from_documents(docs, StoreDefinition("order_vec", 4, metric, 10**9, indexed={"o_orderstatus": "string"}, **more))


def _part_vec(spark: SparkSession, d: str, **more) -> VectorStore:
    v = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).cast("array<float>")
    docs = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("seq"), v.alias("vector"), F.col("p_name").alias("text"), "p_brand", F.to_variant_object(F.struct("p_type", "p_size")).alias("metadata"))
    return VectorStore.from_documents(docs, StoreDefinition("part_vec", 2, "EUCLIDEAN", 10**9, indexed={"p_brand": "string"}, **more))


def _doc_text(spark: SparkSession, d: str) -> VectorStore:
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), character_vector(F.coalesce("text", F.lit(""))).alias("vector"), "text", "lang", "source")
    return VectorStore.from_documents(docs, StoreDefinition("doc_text", 8, "COSINE", 10**9, "char", "1", indexed={"lang": "string", "source": "string"}))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a batch of documents of their users, in (ts, event_id) order."""
    v = F.array(F.col("value"), (F.col("event_id") % 7).cast("double")).cast("array<float>")
    return _table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("batch_seq"), v.alias("vector"), F.col("event_type").alias("text"), F.parse_json("props").alias("metadata"))


_stored: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, table: str, name: str, build: Callable):
    """What ``build`` derives from a table and writes, made once a session, as a store is filled once and searched often.

    A changed table is derived anew: its files' lengths and times are part of the key.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def _saved(spark: SparkSession, d: str, table: str, name: str, build: Callable[[], VectorStore]) -> VectorStore:
    """A store saved to the shared folder and loaded: codes and vectors are read, not computed."""

    def saved() -> VectorStore:
        store = build()
        storage = SnapshotStorage(spark, shared_folder(spark, "stores"))
        storage.save(store)
        return storage.load(store.definition)

    return _once(spark, d, table, name, saved)


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One stated query vector."""
    return [float(x) for x in _table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score"))


_EMB = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
_SCALED = "SELECT vec_id, label, [(x * (1 + label)::FLOAT)::FLOAT FOR x IN embedding]::DOUBLE[] AS v FROM embeddings"
_ZERO = "SELECT vec_id, label, CASE WHEN vec_id % 50 = 0 THEN [0.0 FOR x IN embedding]::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings"
_SCORES = {
    "COSINE": "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0 ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END",
    "DOT_PRODUCT": "list_inner_product({a}, {b})",
    "EUCLIDEAN": "list_distance({a}, {b})",
}
_Q0 = "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0"


def _topk(rows: str = _EMB, metric: str = "COSINE", k: int | None = 10, where: str = "true", having: str = "true", query: str = _Q0) -> str:
    s = _SCORES[metric].format(a="q", b="v")
    way = "ASC" if metric == "EUCLIDEAN" else "DESC"
    return f"SELECT vec_id::VARCHAR AS id, round(score, 6) AS score FROM (SELECT vec_id, {s} AS score FROM ({rows}), ({query}) WHERE {where}) WHERE {having} ORDER BY score {way}, vec_id" + (f" LIMIT {k}" if k else "")


def _search(kind: str, metric: str, **kwargs):
    return lambda spark, d: _hits(search.search_by_vector(_emb(spark, d, metric, kind), _vector(spark, d), payload=False, **kwargs))


# ---------------------------------------------------------------- top-k
_query("topk_cosine", _topk())(_search("plain", "COSINE"))
_query("topk_dot", _topk(_SCALED, "DOT_PRODUCT"))(_search("scaled", "DOT_PRODUCT"))
_query("topk_euclidean", _topk(_SCALED, "EUCLIDEAN"))(_search("scaled", "EUCLIDEAN"))
_query("topk_metric_alias_ip", _topk(_SCALED, "DOT_PRODUCT"))(_search("scaled", "ip"))
_query("topk_metric_alias_l2", _topk(_SCALED, "EUCLIDEAN"))(_search("scaled", "l2"))
_query("topk_metric_unknown", _topk(_SCALED))(_search("scaled", "manhattan"))
_query("topk_zero_vector", _topk(_ZERO, k=None))(_search("zero", "COSINE", top_k=None))
_query("topk_k_floor", _topk(k=1))(_search("plain", "COSINE", top_k=0))
_query("topk_filter_eq", _topk(where="label = 3"))(_search("plain", "COSINE", condition=f.eq("label", 3)))
_query("topk_filter_in", _topk(where="label IN (1, 2)"))(_search("plain", "COSINE", condition=f.in_("label", [1, 2])))
_query("topk_filter_in_nulls", _topk(where="label IN (1, 2)"))(_search("plain", "COSINE", condition=f.in_("label", [None, 1, 2])))
_query("topk_filter_eq_null", _topk(where="false"))(_search("plain", "COSINE", condition=f.eq("label", None)))
_query("topk_filter_kind", _topk(where="false"))(_search("plain", "COSINE", condition=f.eq("label", "3")))
_query("topk_min_score_cosine", _topk(having="score >= 0.2", k=None))(_search("plain", "COSINE", top_k=None, min_score=0.2))
_query("topk_max_distance_l2", _topk(_SCALED, "EUCLIDEAN", having="score <= 2.5", k=None))(_search("scaled", "EUCLIDEAN", top_k=None, min_score=2.5))
_query("topk_filter_mixed_kinds", _topk(where="label IN (1, 3)"))(_search("plain", "COSINE", condition=f.in_("label", [True, 1, "a", None, 3])))
_query("ext_filter_range", _topk(where="label BETWEEN 2 AND 5"))(_search("plain", "COSINE", condition=f.between("label", 2, 5)))
_query("ext_filter_gt_lt", _topk(where="label > 6 OR label < 1"))(_search("plain", "COSINE", condition=f.gt("label", 6) | f.lt("label", 1)))
_query("ext_filter_bool", _topk(where="NOT (label = 1 OR label = 2) AND label <= 7"))(_search("plain", "COSINE", condition=~(f.eq("label", 1) | f.eq("label", 2)) & f.le("label", 7)))


@_query("ext_filter_prefix", "SELECT p_partkey::VARCHAR AS id, round(sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)), 6) AS score FROM part WHERE starts_with(p_brand, 'Brand#1') ORDER BY sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)), p_partkey LIMIT 10")
def ext_filter_prefix(spark, d):
    return _hits(search.search_by_vector(_part_vec(spark, d), [10.0, 12.0], condition=f.prefix("p_brand", "Brand#1"), payload=False))


@_query("topk_filter_variant", "SELECT p_partkey::VARCHAR AS id, round(sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)), 6) AS score FROM part WHERE p_size IN (9, 11, 14) ORDER BY sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)), p_partkey LIMIT 10")
def topk_filter_variant(spark, d):
    return _hits(search.search_by_vector(_part_vec(spark, d), [10.0, 12.0], condition=f.in_("p_size", [9, 11, 14, "10"]), payload=False))


@_query("late_payload", "SELECT t.id, t.score, p_name AS text FROM (SELECT p_partkey::VARCHAR AS id, p_name, round(sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)), 6) AS score, sqrt(power(p_size - 10, 2) + power((p_retailprice / 100)::FLOAT::DOUBLE - 12, 2)) AS s, p_partkey FROM part ORDER BY s, p_partkey LIMIT 10) t")
def late_payload(spark, d):
    """Text of the winners only, read by their positions from a saved store."""
    store = _saved(spark, d, "part", "part_vec", lambda: _part_vec(spark, d))
    return search.search_by_vector(store, [10.0, 12.0]).select("id", F.round("score", 6).alias("score"), "text")


# ---------------------------------------------------------------- batched search
def _batch_sql(rows: str, metric: str, k: int, where: str = "true") -> str:
    s = _SCORES[metric].format(a="q", b="v")
    way = "ASC" if metric == "EUCLIDEAN" else "DESC"
    return f"""SELECT query_id, rank, id, score FROM (
SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s {way}, seq)::INTEGER AS rank FROM (
SELECT qs.vec_id::VARCHAR AS query_id, r.vec_id::VARCHAR AS id, r.vec_id AS seq, {s} AS s FROM ({rows}) r, (SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 25 = 0) qs WHERE {where})) WHERE rank <= {k}"""


def _batch(kind: str, metric: str, k: int, condition=None):
    def run(spark, d):
        queries = _table(spark, d, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        out = search.search_batch(_emb(spark, d, metric, kind), queries, k, condition=condition)
        return out.select("query_id", "rank", "id", F.round("score", 6).alias("score"))

    return run


_query("batch_topk", _batch_sql(_EMB, "COSINE", 10))(_batch("plain", "COSINE", 10))
_query("batch_topk_dot", _batch_sql(_SCALED, "DOT_PRODUCT", 5))(_batch("scaled", "DOT_PRODUCT", 5))
_query("batch_topk_l2", _batch_sql(_SCALED, "EUCLIDEAN", 5))(_batch("scaled", "EUCLIDEAN", 5))
_query("batch_topk_filtered", _batch_sql(_EMB, "COSINE", 10, "label IN (1, 2)"))(_batch("plain", "COSINE", 10, f.in_("label", [1, 2])))


@_query("batch_topk_ties", "SELECT q.vec_id::VARCHAR AS query_id, r.rank, r.vec_id::VARCHAR AS id, 0.0::DOUBLE AS score FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, row_number() OVER (ORDER BY vec_id)::INTEGER AS rank FROM embeddings) r WHERE r.rank <= 10")
def batch_topk_ties(spark, d):
    """Zero vectors as queries: every row ties, the first ten by position win."""
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    queries = _table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), zero.alias("vector"))
    return search.search_batch(_emb(spark, d), queries, 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- paging and stats
def _page(page: int, size: int):
    return lambda spark, d: _doc_text(spark, d).page(page, size).select("id", "text")


for _name, _args, _off, _n in (("list_page_1", (1, 20), 0, 20), ("list_page_3", (3, 15), 30, 15), ("list_page_clamped", (0, 0), 0, 20)):
    _query(_name, f"SELECT doc_id::VARCHAR AS id, text FROM documents ORDER BY doc_id LIMIT {_n} OFFSET {_off}")(_page(*_args))


@_query("store_stats", "SELECT 'emb_plain' AS store_name, 64 AS dimension, count(*) AS doc_count, 1000000000 AS max_capacity, 'COSINE' AS metric, 'NONE' AS quantization FROM embeddings")
def store_stats(spark, d):
    return _emb(spark, d).stats()


@_query("page_search", "SELECT doc_id::VARCHAR AS id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50) WHERE contains(lower(text), 'tion') OR contains(doc_id::VARCHAR, 'tion')")
def page_search(spark, d):
    return _doc_text(spark, d).page(1, 50).where(f.contains("TION")).select("id")


@_query("page_with_vectors", f"SELECT vec_id::VARCHAR AS id, round(v[1], 6) AS first, round(v[64], 6) AS last, len(v)::INTEGER AS dimension FROM ({_EMB}) ORDER BY vec_id LIMIT 25 OFFSET 25")
def page_with_vectors(spark, d):
    page = _emb(spark, d).page(2, 25, vectors=True)
    return page.select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.round(F.col("vector")[63].cast("double"), 6).alias("last"), F.size("vector").alias("dimension"))


# ---------------------------------------------------------------- mutations
_LAST = "SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, min(event_id) OVER (PARTITION BY user_id) AS first FROM events"


def _event_log(spark, d) -> VectorStore:
    return VectorStore.empty(spark, StoreDefinition("event_log", 2, "EUCLIDEAN", 10**9)).upsert(_events(spark, d))


@_query("upsert_latest_wins", f"SELECT user_id::VARCHAR AS id, event_type AS text, round(value::FLOAT::DOUBLE, 3) AS value FROM ({_LAST}) WHERE r = 1")
def upsert_latest_wins(spark, d):
    return _event_log(spark, d).live().select("id", "text", F.round(F.col("vector")[0].cast("double"), 3).alias("value"))


@_query("upsert_keeps_position", f"SELECT user_id::VARCHAR AS id, first AS seq FROM ({_LAST}) WHERE r = 1")
def upsert_keeps_position(spark, d):
    return _event_log(spark, d).live().select("id", "seq")


def _deleted_ids(spark, d) -> tuple[VectorStore, int]:
    return _emb(spark, d).delete_by_ids([str(k) for k in range(10)] + ["3", "nobody", "-1"])


@_query("delete_ids", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id NOT BETWEEN 0 AND 9")
def delete_ids(spark, d):
    return _deleted_ids(spark, d)[0].live().select("id")


def _count(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1).select(F.lit(n).cast("long").alias("deleted"))


@_query("delete_ids_count", "SELECT count(*) AS deleted FROM embeddings WHERE vec_id BETWEEN 0 AND 9")
def delete_ids_count(spark, d):
    return _count(spark, _deleted_ids(spark, d)[1])


@_query("delete_filter", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE label NOT IN (4, 5)")
def delete_filter(spark, d):
    return _emb(spark, d).delete_by_filter(f.in_("label", [4, 5]))[0].live().select("id")


@_query("delete_filter_count", "SELECT count(*) AS deleted FROM embeddings WHERE label IN (4, 5)")
def delete_filter_count(spark, d):
    return _count(spark, _emb(spark, d).delete_by_filter(f.in_("label", [4, 5]))[1])


@_query("reupsert_after_delete", "SELECT vec_id::VARCHAR AS id, vec_id AS seq, CASE WHEN vec_id < 5 THEN 'back' END AS text FROM embeddings WHERE vec_id < 5 OR vec_id > 9")
def reupsert_after_delete(spark, d):
    again = _table(spark, d, "embeddings").where("vec_id < 5").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("batch_seq"), F.col("embedding").alias("vector"), F.lit("back").alias("text"), "label")
    return _deleted_ids(spark, d)[0].upsert(again).live().select("id", "seq", "text")


@_query("upsert_after_position_0", "SELECT c_custkey::VARCHAR AS id, c_custkey - 1 AS seq FROM customer")
def upsert_after_position_0(spark, d):
    """All customers upserted into a store whose only row has position 0."""
    rows = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") - 2).alias("batch_seq"), F.array(F.col("c_acctbal")).cast("array<float>").alias("vector"))
    first = VectorStore.from_documents(rows.where("id = '1'").withColumn("seq", F.lit(0)), StoreDefinition("customers", 1, "EUCLIDEAN", 10**9))
    return first.upsert(rows.where("id <> '1'")).live().select("id", "seq")


@_query("promoted_after_update", "SELECT vec_id::VARCHAR AS id, (CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END)::INTEGER AS label FROM embeddings WHERE (vec_id % 3 = 0 AND label = 2) OR (vec_id % 3 <> 0 AND label = 3)")
def promoted_after_update(spark, d):
    """Promoted fields follow updates: old values match no more, new ones do."""
    rows = _table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("batch_seq"), F.col("embedding").alias("vector"), (F.col("label") + 100).alias("label"))
    store = _emb(spark, d).upsert(rows)
    return search.candidates(store, f.in_("label", [102, 3])).select("id", "label")


def _part_engine(spark, d) -> Engine:
    """Parts in an engine with a snapshot storage, saved after every change."""
    engine = Engine(spark, SnapshotStorage(spark, shared_folder(spark, "engine")))
    store = _part_vec(spark, d)
    engine.create_store("part_vec", store.definition)
    engine.put(store)
    engine.refresh("part_vec")
    engine.reload("part_vec")
    return engine


@_query("snapshot_upsert", "SELECT p_partkey::VARCHAR AS id, p_partkey AS seq, CASE WHEN p_size = 7 THEN 'seven' ELSE p_name END AS text, p_brand FROM part UNION ALL SELECT 'new-' || p_partkey, (SELECT max(p_partkey) FROM part) + 1 + p_partkey, 'new', 'Brand#99' FROM part WHERE p_size = 8")
def snapshot_upsert(spark, d):
    """Updates and new rows upserted into a saved store: only the buckets of their ids are written."""
    engine, v = _part_engine(spark, d), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vector")
    part = _table(spark, d, "part")
    seven = part.where("p_size = 7").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("batch_seq"), v, F.lit("seven").alias("text"), "p_brand")
    eight = part.where("p_size = 8").select(F.concat(F.lit("new-"), "p_partkey").alias("id"), F.col("p_partkey").alias("batch_seq"), v, F.lit("new").alias("text"), F.lit("Brand#99").alias("p_brand"))
    engine.upsert("part_vec", seven.union(eight))
    return engine.get_store("part_vec").live().select("id", "seq", "text", "p_brand")


@_query("snapshot_delete", "SELECT p_partkey::VARCHAR AS id, (SELECT count(*) FROM part WHERE p_brand = 'Brand#12' OR p_size = 9) AS deleted FROM part WHERE p_brand <> 'Brand#12' AND p_size <> 9")
def snapshot_delete(spark, d):
    """Deletions by filter and by ids, saved at once and read from another engine."""
    engine = _part_engine(spark, d)
    n = engine.delete_by_filter("part_vec", f.eq("p_brand", "Brand#12"))
    n += engine.delete_by_ids("part_vec", _table(spark, d, "part").where("p_size = 9").select(F.col("p_partkey").cast("string")))
    again = Engine(spark, engine.storage)
    again.create_store("part_vec", engine.get_store("part_vec").definition)
    again.reload("part_vec")
    return again.get_store("part_vec").live().select("id", F.lit(n).cast("long").alias("deleted"))


@_query("capacity_kept", "SELECT count(*) AS doc_count, true AS refused FROM embeddings")
def capacity_kept(spark, d):
    """An upsert beyond the capacity changes nothing; one of known ids fits."""
    emb = _table(spark, d, "embeddings")
    rows = emb.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("batch_seq"), F.col("embedding").alias("vector"))
    store = VectorStore.empty(spark, StoreDefinition("full", 64, "COSINE", emb.count())).upsert(rows).upsert(rows)
    try:
        store.upsert(rows.withColumn("id", F.concat(F.lit("x"), "id")))
        refused = False
    except ValueError:
        refused = True
    return store.stats().select("doc_count", F.lit(refused).alias("refused"))


@_query("json_import", "SELECT p_partkey::VARCHAR AS id, p_name AS text, p_size::INTEGER AS size FROM part WHERE p_size BETWEEN 3 AND 12")
def json_import(spark, d):
    """All parts written as lines of JSON, imported, and filtered by their metadata."""
    folder = shared_folder(spark, "json")
    part = _table(spark, d, "part")
    line = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("vector"), F.col("p_name").alias("text"), F.struct("p_size", "p_brand").alias("metadata")))
    part.select(line.alias("value")).write.text(folder)
    rows = read_documents_json(spark, folder)
    return rows.where(f.between("p_size", 3, 12).column({})).select("id", "text", F.try_variant_get("metadata", "$.p_size", "int").alias("size"))


@_query("search_after_delete", _topk(where="vec_id NOT BETWEEN 0 AND 9"))
def search_after_delete(spark, d):
    return _hits(search.search_by_vector(_deleted_ids(spark, d)[0], _vector(spark, d), payload=False))


# ---------------------------------------------------------------- SQ8
_OV = "SELECT o_orderkey AS id, [x::FLOAT::DOUBLE FOR x IN [o_totalprice / 1000, month(o_orderdate)::DOUBLE, day(o_orderdate)::DOUBLE, substr(o_orderpriority, 1, 1)::DOUBLE]] AS v FROM orders"
_PAR = f"SELECT dim, min(x) AS lo, greatest(max(x) - min(x), 1e-7) / 255 AS sc FROM (SELECT generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM (SELECT * FROM ({_OV}) ORDER BY id LIMIT 1024)) GROUP BY dim"
_CODES = f"""WITH par AS ({_PAR}), flat AS (SELECT id, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM ({_OV})),
codes AS (SELECT id, dim, x, lo, sc, greatest(-128, least(127, floor((x - lo) / sc - 128 + 0.5)))::INTEGER AS code FROM flat JOIN par USING (dim))"""


def _sq8(spark, d, metric: str = "EUCLIDEAN") -> VectorStore:
    """Orders with codes, which are written once and read."""
    return _saved(spark, d, "orders", f"order_vec {metric}", lambda: _order_vec(spark, d, metric, quantization="SQ8"))


def _sq8_emb(spark, d, metric: str = "COSINE") -> VectorStore:
    return _saved(spark, d, "embeddings", f"emb_sq8 {metric}", lambda: _emb(spark, d, metric, quantization="SQ8", freeze_rows=256))


@_query("sq8_params", f"SELECT dim::INTEGER AS dim, round(lo, 6) AS min, round(sc, 9) AS scale FROM ({_PAR})")
def sq8_params(spark, d):
    return sq8.calibrate(_order_vec(spark, d).rows, 1024).select("dim", F.round("min", 6).alias("min"), F.round("scale", 9).alias("scale"))


@_query("sq8_codes", f"{_CODES} SELECT id::VARCHAR AS id, dim::INTEGER AS dim, code FROM codes")
def sq8_codes(spark, d):
    return _sq8(spark, d).rows.select("id", F.posexplode("code").alias("dim", "code")).select("id", "dim", F.col("code").cast("int").alias("code"))


@_query("sq8_dequantized", f"{_CODES} SELECT id::VARCHAR AS id, dim::INTEGER AS dim, round(lo + sc * (code + 128), 6) AS value FROM codes")
def sq8_dequantized(spark, d):
    store = _sq8(spark, d)
    return store.rows.select("id", F.posexplode(sq8.dequantized(F.col("code"), store.params)).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("value"))


@_query("sq8_clamped", f"{_CODES} SELECT dim::INTEGER AS dim, count(*) AS clamped FROM codes WHERE x < lo - sc / 2 OR x > lo + 255.5 * sc GROUP BY dim")
def sq8_clamped(spark, d):
    store = _sq8(spark, d)
    p = store.params
    ends = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(p.low, p.scale, strict=True))], "dim int, lo double, sc double")
    flat = store.rows.select(F.posexplode(vectors.doubles(F.col("vector"))).alias("dim", "x"))
    return flat.join(F.broadcast(ends), "dim").where("x < lo - sc / 2 or x > lo + 255.5 * sc").groupBy("dim").agg(F.count(F.lit(1)).alias("clamped"))


_SQ8_SCORE = {
    "COSINE": "sum(q * y) / (sqrt(sum(y * y)) * sqrt(sum(q * q)))",
    "DOT_PRODUCT": "sum(q * y)",
    "EUCLIDEAN": "sqrt(greatest(0, sum(q * q) + sum(y * y) - 2 * sum(q * y)))",
}
for _metric, _short in (("COSINE", "cosine"), ("DOT_PRODUCT", "dot"), ("EUCLIDEAN", "l2")):
    _way = "ASC" if _metric == "EUCLIDEAN" else "DESC"

    def _run(spark, d, metric=_metric):
        return search.search_by_vector(_sq8(spark, d, metric), [150.0, 6.0, 15.0, 3.0], payload=False).select(F.round("score", 4).alias("score"))

    _query(f"sq8_topk_{_short}", f"{_CODES}, s AS (SELECT id, {_SQ8_SCORE[_metric]} AS s FROM (SELECT id, lo + sc * (code + 128) AS y, [150.0, 6.0, 15.0, 3.0][dim + 1]::DOUBLE AS q FROM codes) GROUP BY id) SELECT round(s, 4) AS score FROM s ORDER BY s {_way}, id LIMIT 10")(_run)


_PAR_EMB = f"SELECT dim, min(x) AS lo, greatest(max(x) - min(x), 1e-7) / 255 AS sc FROM (SELECT generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM (SELECT * FROM ({_EMB}) ORDER BY vec_id LIMIT 256)) GROUP BY dim"
_CODES_EMB = f"""WITH par AS ({_PAR_EMB}), flat AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM ({_EMB})),
q AS (SELECT generate_subscripts(q, 1) - 1 AS dim, unnest(q) AS q FROM ({_Q0})),
codes AS (SELECT vec_id, dim, lo, sc, q, greatest(-128, least(127, floor((x - lo) / sc - 128 + 0.5)))::INTEGER AS code FROM flat JOIN par USING (dim) JOIN q USING (dim)),
deq AS (SELECT vec_id, q, lo + sc * (code + 128) AS y FROM codes)"""
for _metric, _short in (("COSINE", "cosine"), ("DOT_PRODUCT", "dot"), ("EUCLIDEAN", "l2")):

    def _run_ids(spark, d, metric=_metric):
        return search.search_by_vector(_sq8_emb(spark, d, metric), _vector(spark, d), payload=False).select("id", F.round("score", 6).alias("score"))

    _way = "ASC" if _metric == "EUCLIDEAN" else "DESC"
    _query(f"sq8_ids_{_short}", f"{_CODES_EMB}, s AS (SELECT vec_id, {_SQ8_SCORE[_metric]} AS s FROM deq GROUP BY vec_id) SELECT vec_id::VARCHAR AS id, round(s, 6) AS score FROM s ORDER BY s {_way}, vec_id LIMIT 10")(_run_ids)


@_query("sq8_snapshot", f"{_CODES} SELECT id::VARCHAR AS id, list(code ORDER BY dim)::INTEGER[] AS code FROM codes WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY id")
def sq8_snapshot(spark, d):
    """Codes after a deletion, a save and a load are those of before: they are read, not made again."""
    store = _sq8(spark, d).delete_by_filter(f.eq("o_orderstatus", "P"))[0]
    storage = SnapshotStorage(spark, shared_folder(spark, "snapshots"))
    storage.save(store)
    return storage.load(store.definition).live().select("id", F.col("code").cast("array<int>").alias("code"))


@_query("sq8_warmup", _topk())
def sq8_warmup(spark, d):
    """A store below the freeze target searches its exact vectors."""
    return _hits(search.search_by_vector(_emb(spark, d, quantization="SQ8", freeze_rows=10**8), _vector(spark, d), payload=False))


@_query("ext_rerank", _topk())
def ext_rerank(spark, d):
    return _hits(search.search_reranked(_sq8_emb(spark, d), _vector(spark, d), factor=10))


@_query("sq8_recall")
def sq8_recall(spark, d):
    """Recall at 10 of SQ8 against exact search for every 25th vector."""
    queries = _table(spark, d, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = search.search_batch(_emb(spark, d), queries, 10).select("query_id", "id")
    coded = search.search_batch(_sq8_emb(spark, d), queries, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(coded, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def _ivf(spark, d) -> IvfIndex:
    """Written once; about the root of the number of rows of lists."""
    return _once(spark, d, "embeddings", "ivf", lambda: IvfIndex.build(_emb(spark, d)))


@_query("ivf_topk")
def ivf_topk(spark, d):
    """As many lists as a recall of 0.92 over sampled queries takes."""
    index = _ivf(spark, d)
    probes = _once(spark, d, "embeddings", "ivf probes", index.enough)
    return _hits(index.search(_vector(spark, d), 10, probes))


@_query("ivf_all_lists", _topk())
def ivf_all_lists(spark, d):
    """Every list probed: the exact result."""
    index = _ivf(spark, d)
    return _hits(index.search(_vector(spark, d), 10, len(index.centers)))


@_query("routed_topk", _topk(where="label = 3"))
def routed_topk(spark, d):
    """A filter that leaves few candidates is routed to the exact search."""
    return _hits(_ivf(spark, d).search_routed(_vector(spark, d), 10, f.eq("label", 3))[1])


@_query("ivf_recall")
def ivf_recall(spark, d):
    """Recall at 10 of inverted lists against exact search for every 100th vector, by the number of lists probed."""
    queries = _table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _ivf(spark, d).recall(queries).select("probes", F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------- text
_CV = "[(CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE (unicode(substr(text, (i % length(text) + 1)::BIGINT, 1)) % 26) / 26.0 END)::FLOAT FOR i IN range(8)]::DOUBLE[]"
_TEXTQ = "[(x % 26) / 26.0 FOR x IN [116, 104, 101, 32, 97, 110, 100, 32]]"
_TEXT = f"WITH r AS (SELECT doc_id, {_CV} AS v FROM documents), q AS (SELECT {_TEXTQ}::DOUBLE[] AS q) SELECT doc_id::VARCHAR AS id, round(s, 6) AS score FROM (SELECT doc_id, {_SCORES['COSINE'].format(a='q', b='v')} AS s FROM r, q) ORDER BY s DESC, doc_id LIMIT 10"


def _registry() -> Registry:
    return Registry([Model("char", "1", "character", is_default=True, batch_size=4)], {"character": CharacterProvider(8)})


@_query("text_search", _TEXT)
def text_search(spark, d):
    store = _saved(spark, d, "documents", "doc_text", lambda: _doc_text(spark, d))
    return _hits(search.search_by_text(store, "the and ", _registry(), payload=False))


@_query("hybrid_dispatch", _TEXT)
def hybrid_dispatch(spark, d):
    store = _saved(spark, d, "documents", "doc_text", lambda: _doc_text(spark, d))
    return _hits(search.hybrid_search(store, None, "the and ", _registry(), payload=False))


@_query("auto_embed", f"SELECT doc_id::VARCHAR AS id, [round(x, 5) FOR x IN {_CV}] AS vector FROM documents WHERE text IS NOT NULL")
def auto_embed(spark, d):
    """Every document with a text."""
    engine = Engine(spark, registry=_registry())
    engine.create_store("docs", StoreDefinition("docs", 8, "COSINE", 10**9, "char"))
    batch = _table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("batch_seq"), "text")
    return engine.upsert("docs", batch).live().select("id", F.transform(vectors.doubles(F.col("vector")), lambda x: F.round(x, 5)).alias("vector"))


# ---------------------------------------------------------------- profiles
@_query("vector_profile", "SELECT vec_id::VARCHAR AS id, round(sqrt(list_inner_product(v, v)), 6) AS l2, round(list_min(v), 6) AS least, round(list_max(v), 6) AS greatest, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS variance FROM (" + _SCALED + ")")
def vector_profile(spark, d):
    p = vectors.profile(F.col("vector"))
    return _emb(spark, d, kind="scaled").live().select("id", *[F.round(c, 6).alias(n) for n, c in p.items()])


@_query("dim_contribution", f"SELECT vec_id::VARCHAR AS id, dim::INTEGER AS dim, round(v[dim + 1] * q[dim + 1], 9) AS contribution FROM ({_EMB}), ({_Q0}), range(64) t(dim)")
def dim_contribution(spark, d):
    """Every vector."""
    rows = _emb(spark, d).live()
    return rows.select("id", F.posexplode(vectors.contributions(F.col("vector"), F.lit(_vector(spark, d)))).alias("dim", "c")).select("id", "dim", F.round("c", 9).alias("contribution"))


@_query("display_similarity", f"SELECT id, round(1 / (1 + s), 6) AS shown, CASE WHEN 1 / (1 + s) >= 0.9 THEN 'very high' WHEN 1 / (1 + s) >= 0.75 THEN 'high' WHEN 1 / (1 + s) >= 0.6 THEN 'medium' WHEN 1 / (1 + s) >= 0.4 THEN 'low' ELSE 'very low' END AS label FROM (SELECT vec_id::VARCHAR AS id, {_SCORES['EUCLIDEAN'].format(a='q', b='v')} AS s FROM ({_SCALED}), ({_Q0}))")
def display_similarity(spark, d):
    rows = search.scored(_emb(spark, d, "EUCLIDEAN", "scaled"), _vector(spark, d))
    shown = vectors.display_similarity("L2", F.col("score"))
    return rows.select("id", F.round(shown, 6).alias("shown"), vectors.similarity_label(shown).alias("label"))


@_query("search_metrics", "SELECT count(*) AS hits, max(score) AS max_score, min(score) AS min_score FROM (" + _topk(_SCALED, "DOT_PRODUCT") + ")")
def search_metrics(spark, d):
    m = search.search_metrics(search.search_by_vector(_emb(spark, d, "DOT_PRODUCT", "scaled"), _vector(spark, d), payload=False))
    return m.select("hits", F.round("max_score", 6).alias("max_score"), F.round("min_score", 6).alias("min_score"))


@_query("vector_sample", f"SELECT vec_id::VARCHAR AS id, dim::INTEGER AS dim, round(v[dim + 1], 6) AS value FROM ({_EMB}), (SELECT i * 2 AS dim FROM range(32) t(i))")
def vector_sample(spark, d):
    """32 evenly spaced dimensions of every vector."""
    picked = _emb(spark, d).live().select("id", F.posexplode(vectors.sampled(F.col("vector"))).alias("k", "x"))
    return picked.select("id", (2 * F.col("k")).alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


@_query("snapshot_roundtrip", f"SELECT p_partkey::VARCHAR AS id, p_partkey AS seq, p_name AS text, p_brand, p_size::INTEGER AS size, round(p_size::FLOAT::DOUBLE, 6) AS first, round((p_retailprice / 100)::FLOAT::DOUBLE, 4) AS second FROM part WHERE p_brand <> 'Brand#11'")
def snapshot_roundtrip(spark, d):
    """A store saved after a deletion and loaded again."""
    store = _part_vec(spark, d).delete_by_filter(f.eq("p_brand", "Brand#11"))[0]
    storage = SnapshotStorage(spark, shared_folder(spark, "snapshots"))
    storage.save(store)
    loaded = storage.load(store.definition).live()
    size = F.try_variant_get("metadata", "$.p_size", "int").alias("size")
    first, second = F.round(F.col("vector")[0].cast("double"), 6), F.round(F.col("vector")[1].cast("double"), 4)
    return loaded.select("id", "seq", "text", "p_brand", size, first.alias("first"), second.alias("second"))


@_query("metadata_eq_by_kind", "SELECT event_id::VARCHAR AS id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract(props, '$.k')::DOUBLE = 3")
def metadata_eq_by_kind(spark, d):
    rows = _events(spark, d).select(F.col("batch_seq").cast("string").alias("id"), "metadata")
    return rows.where(f.eq("k", 3).column({})).select("id")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: top 10 by cosine among two labels."""
    return QUERIES["topk_filter_in"](spark, d)
