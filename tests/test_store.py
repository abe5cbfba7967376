"""Stores by the rules: mutations, filters, quantization, snapshots, embedding, streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.functions import sq8
from stellate.functions.embedding import CharacterProvider, Model, Registry, embed_chunks, parse_response
from stellate.operators import filters as f, search
from stellate.plans.definition import StoreDefinition
from stellate.plans.engine import Engine
from stellate.sources.snapshot import SnapshotStorage, demo_documents, read_documents_json
from stellate.store import VectorStore
from stellate.streaming.ingest import upsert_stream


def batch(spark, rows):
    """(id, vector, text, metadata) in order."""
    frame = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], t, json.dumps(m) if m is not None else None, k) for k, (i, v, t, m) in enumerate(rows)], "id string, vector array<float>, text string, m string, batch_seq long")
    return frame.withColumn("metadata", F.parse_json("m")).drop("m")


def unit(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def ids(frame):
    return [r["id"] for r in frame.collect()]


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_recall_is_exact(spark, metric):
    v = np.random.default_rng(2026).uniform(-1, 1, size=(300, 48)).astype(np.float32)
    docs = spark.createDataFrame([(str(k), k, [float(x) for x in row]) for k, row in enumerate(v)], "id string, seq long, vector array<float>")
    store = VectorStore.from_documents(docs, StoreDefinition("acc", 48, metric))
    qs = v[:5] + 0.1
    frame = spark.createDataFrame([(str(k), [float(x) for x in q]) for k, q in enumerate(qs)], "query_id string, vector array<double>")
    got = {}
    for r in search.search_batch(store, frame, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for k, q in enumerate(qs.astype(float)):
        w = v.astype(float)
        s = {"COSINE": w @ q / np.linalg.norm(w, axis=1) / np.linalg.norm(q), "DOT_PRODUCT": w @ q, "EUCLIDEAN": -np.linalg.norm(w - q, axis=1)}[metric]
        want = [str(i) for i in np.argsort(-s, kind="stable")[:10]]
        assert got[str(k)] == want
        if k == 0:
            assert ids(search.search_by_vector(store, list(q))) == want


def test_upsert_delete_and_revive(spark):
    d = StoreDefinition("s", 2, "EUCLIDEAN", 3, indexed={"category": "string"})
    s = VectorStore.empty(spark, d).upsert(batch(spark, [("a", [1, 0], "A", {"category": "x"}), ("b", [0, 1], "B", None), ("a", [2, 0], None, {"category": "y"})]))
    assert [(r["id"], r["text"]) for r in s.page().collect()] == [("a", None), ("b", "B")]
    assert ids(s.live().where(f.eq("category", "x").column(d.indexed))) == [] and ids(s.live().where(f.eq("category", "y").column(d.indexed))) == ["a"]
    s, n = s.delete_by_ids(["a", "a", "zz"])
    assert n == 1 and ids(s.page()) == ["b"] and s.delete_by_ids([])[1] == s.delete_by_ids(None)[1] == s.delete_by_ids(["a"])[1] == 0
    s = s.upsert(batch(spark, [("c", [5, 5], None, None), ("a", [3, 0], "again", None)]))
    assert ids(s.page()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        s.upsert(batch(spark, [("d", [0, 0], None, None)]))
    assert s.delete_by_filter(None)[1] == 0 and s.delete_by_filter(f.eq("category", "x"))[1] == 0
    assert ids(search.search_by_vector(s, [3, 0], top_k=-4)) == ["a"] and ids(s.page(-1, 0)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        search.search_by_vector(s, [1.0])
    for bad in ([1, 2, 3], None, [float("nan"), 0]):
        with pytest.raises(Exception, match="finite"):
            s.upsert(batch(spark, [("e", bad, None, None)])).rows.collect()


def test_filters_compare_by_kind(spark):
    rows = batch(spark, [("i", [1], None, {"v": 1}), ("s", [1], None, {"v": "1"}), ("f", [1], None, {"v": 1.0}), ("b", [1], None, {"v": True}), ("n", [1], None, {"v": None}), ("m", [1], None, {}), ("0", [1], None, None)])
    s = VectorStore.empty(spark, StoreDefinition("k", 1)).upsert(rows)
    hits = lambda c: sorted(ids(search.candidates(s, c)))
    assert hits(f.eq("v", 1)) == ["f", "i"] and hits(f.eq("v", "1")) == ["s"] and hits(f.eq("v", True)) == ["b"]
    assert hits(f.eq("v", None)) == hits(f.in_("v", [None])) == hits(f.in_("v", [])) == hits(f.in_("v", None)) == []
    assert hits(f.in_("v", [None, "1", 1])) == ["f", "i", "s"] and len(hits(f.eq(None, 3))) == 7
    assert hits(f.gt("v", 0) & ~f.eq("v", "1")) == ["f", "i"] and hits(f.prefix("v", "1")) == ["s"]


def test_frozen_codes_do_not_drift(spark):
    v = unit(80, 8, 7)
    d = StoreDefinition("q", 8, "COSINE", quantization="SQ8", freeze_rows=64)
    first = VectorStore.empty(spark, d).upsert(batch(spark, [(str(k), [float(x) for x in r], None, None) for k, r in enumerate(v)]))
    assert first.params is not None
    before = {r["id"]: r["score"] for r in search.search_by_vector(first, [float(x) for x in v[50]], 80).collect()}
    far = first.upsert(batch(spark, [(f"far{k}", [float(100 * x) for x in r], None, None) for k, r in enumerate(unit(5, 8, 9))]))
    after = {r["id"]: r["score"] for r in search.search_by_vector(far, [float(x) for x in v[50]], 85).collect()}
    assert far.params == first.params and all(after[k] == s for k, s in before.items()) and len(after) == 85
    low, scale = np.array(first.params.low), np.array(first.params.scale)
    want = np.clip(np.floor((v.astype(float) - low) / scale - 128 + 0.5), -128, 127)
    got = {r["id"]: r["code"] for r in first.rows.collect()}
    assert all(got[str(k)] == want[k].astype(int).tolist() for k in range(80))
    assert VectorStore.empty(spark, d).upsert(batch(spark, [("x", [1.0] * 8, None, None)])).params is None
    constant = sq8.Params((0.3,), (1e-7 / 255,))
    assert spark.createDataFrame([([0.3],)], "v array<double>").select(sq8.quantized(F.col("v"), constant).alias("c")).first()["c"] == [-128]
    assert sq8.freeze_target(0) == 1024 and sq8.freeze_target(10) == 10


def test_snapshots(spark, tmp_path):
    storage = SnapshotStorage(spark, f"file://{tmp_path}")
    d = StoreDefinition("snap", 8, "COSINE", quantization="SQ8", freeze_rows=32, indexed={"k": "string"})
    s = VectorStore.empty(spark, d).upsert(batch(spark, [(str(k), [float(x) for x in r], f"t{k}", {"k": f"old_{k}"}) for k, r in enumerate(unit(40, 8, 42))]))
    s, _ = s.delete_by_ids(["5"])
    q = [float(x) for x in unit(1, 8, 1)[0]]
    want = [(r["id"], r["score"]) for r in search.search_by_vector(s, q).collect()]
    assert storage.load(d) is None
    for _ in range(2):
        storage.save(s)
        s = storage.load(d)
        assert [(r["id"], r["score"]) for r in search.search_by_vector(s, q).collect()] == want and s.rows.count() == 39
    assert ids(s.live().where(f.eq("k", "old_3").column(d.indexed))) == ["3"]
    for other in (d.renamed(dimension=4), d.renamed(metric="L2"), d.renamed(quantization="NONE")):
        with pytest.raises(ValueError):
            storage.load(other)
    storage.delete("snap")
    assert storage.load(d) is None


def folders(path):
    return {p.name for p in path.iterdir() if p.name.startswith("v-")}


def test_changes_of_a_saved_store_touch_some_buckets(spark, tmp_path):
    storage = SnapshotStorage(spark, f"file://{tmp_path}", keep=2)
    d = StoreDefinition("b", 2, "EUCLIDEAN", 1000, indexed={"k": "string"}, buckets=8)
    rows = [(str(k), [k, 1], f"t{k}", {"k": f"v{k % 5}"}) for k in range(60)]
    engine = Engine(spark, storage)
    engine.create_store("b", d)
    engine.upsert("b", batch(spark, rows))
    first = storage.current("b")
    assert first["count"] == 60 and first["top"] == 59 and len({*first["buckets"].values()}) == 1
    engine.upsert("b", batch(spark, [("7", [70, 1], "seven", {"k": "x"}), ("new", [0, 0], "n", None)]))
    second = storage.current("b")
    changed = {k for k in second["buckets"] if second["buckets"][k] != first["buckets"].get(k)}
    assert 1 <= len(changed) <= 2 and second["count"] == 61 and second["top"] == 61 and second["number"] == 2
    store = engine.get_store("b")
    got = {r["id"]: (r["seq"], r["text"], r["vector"]) for r in store.live().collect()}
    assert got["7"] == (7, "seven", [70.0, 1.0]) and got["new"][0] == 61 and got["8"] == (8, "t8", [8.0, 1.0]) and len(got) == 61
    assert engine.delete_by_ids("b", ["8", "8", "nobody"]) == 1 and engine.delete_by_filter("b", f.eq("k", "x")) == 1
    assert storage.current("b")["count"] == 59 and len(folders(tmp_path / "b")) == 1 + len({v for n in (3, 4) for v in storage._pointer("b", n)["buckets"].values()} - {*first["buckets"].values()})
    assert sorted(p.name for p in (tmp_path / "b/pointer").iterdir() if p.name.isdigit()) == [f"{n:012d}" for n in (3, 4)]
    engine.upsert("b", batch(spark, [("8", [8, 8], "back", None)]))
    again = Engine(spark, storage)
    again.create_store("b", d)
    again.reload("b")
    assert {r["id"]: r["seq"] for r in again.get_store("b").live().collect()}["8"] == 8 and again.stats("b").first()["doc_count"] == 60
    with pytest.raises(ValueError):
        engine.upsert("b", batch(spark, [(f"x{k}", [0, 0], None, None) for k in range(950)]))
    assert storage.current("b")["count"] == 60
    engine.upsert("b", batch(spark, [("after", [0, 0], None, None)]))  # a failed writer gave its claim back
    (tmp_path / f"b/pointer/{storage.current('b')['number'] + 1:012d}.claim").write_text("")
    with pytest.raises(RuntimeError, match="another writer"):
        engine.upsert("b", batch(spark, [("late", [0, 0], None, None)]))


def test_saved_store_freezes_once_and_keeps_codes(spark, tmp_path):
    storage = SnapshotStorage(spark, f"file://{tmp_path}")
    engine = Engine(spark, storage)
    engine.create_store("q", StoreDefinition("q", 8, "COSINE", quantization="SQ8", freeze_rows=32, buckets=4))
    rows = [(str(k), [float(x) for x in r], None, None) for k, r in enumerate(unit(40, 8, 3))]
    engine.upsert("q", batch(spark, rows[:20]))
    assert engine.get_store("q").params is None
    engine.upsert("q", batch(spark, rows[20:]))
    store = engine.get_store("q")
    assert store.params is not None and storage.current("q")["frozen"]
    plan = search.scored(store, rows[0][1]).select("id", "seq", "score")._jdf.queryExecution().executedPlan().toString()
    assert "code:array<tinyint>" in plan and "vector:array" not in plan  # the scan reads codes only
    codes = {r["id"]: r["code"] for r in store.rows.collect()}
    engine.upsert("q", batch(spark, [("far", [100.0] * 8, None, None)]))
    store = engine.get_store("q")
    now = {r["id"]: r["code"] for r in store.rows.collect()}
    assert {k: now[k] for k in codes} == codes and now["far"] == [127] * 8


def test_store_with_position_0_and_other_kinds(spark):
    d = StoreDefinition("z", 1, indexed={"n": "int", "a.b": "string"})
    s = VectorStore.empty(spark, d).upsert(batch(spark, [("a", [1], None, {"n": 1, "a.b": "x"})])).upsert(batch(spark, [("b", [1], None, {"n": 2})]))
    assert [(r["id"], r["seq"]) for r in s.page().select("id").join(s.rows.select("id", "seq"), "id").orderBy("seq").collect()] == [("a", 0), ("b", 1)]
    hits = lambda c: sorted(ids(search.candidates(s, c)))
    assert hits(f.in_("n", [True])) == hits(f.in_("n", ["1"])) == hits(f.eq("n", True)) == [] and hits(f.in_("n", [1, "a", True])) == ["a"] and hits(f.in_("n", [1.0, 2])) == ["a", "b"]
    assert hits(f.eq("a.b", "x")) == hits(f.in_("a.b", ["x", 3])) == hits(f.prefix("a.b", "x")) == ["a"]


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_best_of_is_brute_force(metric):
    rng = np.random.default_rng(1)
    for n, dim, n_q, k in ((9000, 16, 40, 5), (50, 8, 7, 10), (10000, 4, 10, 3), (1, 3, 2, 10), (8200, 32, 5, 300)):
        v, q, seq = rng.normal(size=(n, dim)).astype(np.float32), rng.normal(size=(n_q, dim)), rng.permutation(n)
        v[rng.random(n) < 0.5], q[0], v[n // 2] = v[0], 0, 0  # ties and zero vectors
        x, y, s = search.best_of(q, v, seq, metric, k)
        for i in range(n_q):
            exact = search.exact_scores(q[i], v, metric)
            want = np.lexsort((seq, exact if metric == "EUCLIDEAN" else -exact))[:k]
            assert list(y[x == i]) == list(want) and (s[x == i] == exact[want]).all()


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_many_queries_take_bounded_memory_and_equal_ones_no_time(metric):
    import tracemalloc

    rng = np.random.default_rng(2)
    v, q, seq = rng.normal(size=(9000, 16)).astype(np.float32), rng.normal(size=(12000, 16)), rng.permutation(9000)
    q[3000:6000], q[6000:9000] = 0, q[5]
    tracemalloc.start()
    x, y, s = search.best_of(q, v, seq, metric, 5)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    for i in [*range(0, 12000, 501), 3001, 7000]:
        exact = search.exact_scores(q[i], v, metric)
        want = np.lexsort((seq, exact if metric == "EUCLIDEAN" else -exact))[:5]
        assert list(y[x == i]) == list(want) and (s[x == i] == exact[want]).all()
    assert len(x) == 60000 and (np.diff(x) >= 0).all()


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_codes_and_rising_scores_are_brute_force(metric):
    from stellate.functions.sq8 import Params

    rng = np.random.default_rng(4)
    codes, q, seq = rng.integers(-128, 128, size=(3000, 8)).astype(np.int8), rng.normal(size=(20, 8)), rng.permutation(3000)
    params = Params(tuple(rng.normal(size=8)), tuple(rng.uniform(0.01, 0.1, 8)))
    v = np.array(params.low) + np.array(params.scale) * (codes.astype(float) + 128)
    order = np.argsort(-search.exact_scores(q[0], v, metric) if metric == "EUCLIDEAN" else search.exact_scores(q[0], v, metric))
    codes, v = codes[order], v[order]  # each step has better rows than the ones before
    x, y, s = search.best_of(q, codes, seq, metric, 2, step=100, params=params)
    for i in range(20):
        exact = search.exact_scores(q[i], v, metric)
        want = np.lexsort((seq, exact if metric == "EUCLIDEAN" else -exact))[:2]
        assert list(y[x == i]) == list(want) and (s[x == i] == exact[want]).all()


def test_batch_in_several_blocks_and_chunks(spark, monkeypatch):
    v = unit(300, 8, 5)
    docs = spark.createDataFrame([(str(k), k, [float(x) for x in row]) for k, row in enumerate(v)], "id string, seq long, vector array<float>")
    store = VectorStore.from_documents(docs, StoreDefinition("m", 8))
    queries = docs.select(F.col("id").alias("query_id"), "vector")
    whole = sorted(search.search_batch(store, queries, 3).collect())
    monkeypatch.setattr(search, "BLOCK_BYTES", 64 * 40)
    assert all(isinstance(x, str) for x in search.query_blocks(queries, 8)) and len(search.query_blocks(queries, 8)) > 1 and sorted(search.search_batch(store, queries, 3).collect()) == whole and len(whole) == 900
    assert search.search_batch(store, queries.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="8 numbers"):
        search.search_batch(store, spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>"))


class Counting(CharacterProvider):
    def __init__(self):
        super().__init__(8)
        self.sizes = []

    def embed(self, model, version, texts):
        self.sizes.append(len(texts))
        return super().embed(model, version, texts)


def test_embedding(spark, tmp_path):
    provider = Counting()
    assert len(embed_chunks(provider, "m", "1", [str(k) for k in range(10)], 4)) == 10 and provider.sizes == [4, 4, 2]
    for shape in ({"data": [{"embedding": [1]}]}, {"data": [[1]]}, {"embedding": [1]}, [[1]]):
        assert parse_response(shape) == [[1.0]]
    with pytest.raises(ValueError):
        parse_response({"other": 1})
    engine = Engine.from_config(spark, {"snapshot_root": f"file://{tmp_path}", "models": [{"name": "char", "provider": "character", "is_default": True}], "stores": [{"name": "docs", "dimension": 8, "embedding_model": "char"}, {"name": "free", "dimension": 8}]}, {"character": CharacterProvider(8)})
    assert engine.list_stores() == ["docs", "free"] and engine.get_store("docs").definition.embedding_version == "1"
    engine.upsert("docs", batch(spark, [("1", None, "hello", None), ("2", [1.0] * 8, "kept vector", None)]))
    assert ids(engine.search("docs", "TEXT", text="hello", top_k=1)) == ["1"] == ids(engine.search("docs", "HYBRID", text="hello", top_k=1))
    assert engine.get_store("docs").rows.where("id = '2'").first()["vector"] == [1.0] * 8
    with pytest.raises(ValueError):
        engine.upsert("docs", batch(spark, [("3", None, None, None)]))
    with pytest.raises(RuntimeError):
        engine.upsert("free", batch(spark, [("3", None, "text", None)]))
    with pytest.raises(ValueError):
        engine.create_store("docs", StoreDefinition("docs", 8, embedding_model="other"))
    with pytest.raises(ValueError):
        engine.create_store("docs", StoreDefinition("docs", 8))
    assert engine.create_store("docs", StoreDefinition("docs", 99, embedding_model="char")).definition.dimension == 8
    assert engine.list_documents("docs", 0, 1)["total"] == 2 and engine.stats("docs").first()["doc_count"] == 2
    engine.reset("docs")
    engine.reload("docs")
    assert engine.stats("docs").first()["doc_count"] == 2
    engine.drop_store("docs")
    engine.drop_store("docs")
    assert not engine.has_store("docs") and not engine.has_store(None)
    with pytest.raises(ValueError):
        engine.get_store("docs")
    with pytest.raises(ValueError):
        Registry([Model("a")]).resolve(None)


def test_stream_and_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('[{"id": "x", "vector": [1, 2], "text": "t", "metadata": {"a": 1}}, {"id": "y", "vector": [3, 4]}]')
    docs = read_documents_json(spark, f"file://{tmp_path}/in/a.json")
    assert [(r["id"], r["vector"]) for r in docs.collect()] == [("x", [1.0, 2.0]), ("y", [3.0, 4.0])]
    docs.selectExpr("id", "vector", "text", "cast(ascii(id) as bigint) as n").write.parquet(f"file://{tmp_path}/stream")
    engine = Engine(spark)
    engine.create_store("s", StoreDefinition("s", 2))
    source = spark.readStream.schema("id string, vector array<float>, text string, n long").parquet(f"file://{tmp_path}/stream")
    upsert_stream(engine, "s", source, f"file://{tmp_path}/cp", "n").awaitTermination(120)
    assert sorted(ids(engine.get_store("s").live())) == ["x", "y"]
    demo = VectorStore.from_documents(demo_documents(spark), StoreDefinition("demo", 128, indexed={"category": "string"}))
    assert demo.live().count() == 20 and demo.live().where(f.eq("category", "news").column(demo.definition.indexed)).count() == 7


def test_pushdown(spark):
    from stellate.queries import _emb

    plan = search.candidates(_emb(spark, "/root/testdata/sf0.001"), f.in_("label", [1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label, [1,2])]" in plan


def test_entry_without_optional_parts(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    monkeypatch.setattr(entry, "llm", None)
    assert "topk_cosine" in entry.queries() and not any(n.startswith("op") for n in entry.queries()) and {*entry.oracle_sql()} <= {*entry.queries()}
