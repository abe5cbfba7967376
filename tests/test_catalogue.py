"""Every query of the catalogue against its DuckDB SQL."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from stellate import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(frame):
    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([float(x) for x in v])
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).to_numpy().tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_recall(spark):
    assert queries.QUERIES["sq8_recall"](spark, FOLDER).first()["recall"] > 0.9
    assert queries.QUERIES["ivf_topk"](spark, FOLDER).first()["id"] == "0"


def test_ivf_probes_reach_the_recall_and_prune(spark):
    from pyspark.sql import functions as F
    from stellate.operators import filters as f
    from stellate.operators.ivf import IvfIndex
    from stellate.operators.search import search_batch

    folder = "/root/testdata/sf0.01"
    index = IvfIndex.build(queries._emb(spark, folder), lists=8)
    probes = index.enough()
    every = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    report = {r["probes"]: r["recall"] for r in index.recall(every.where("query_id % 3 = 0")).collect()}
    assert sorted(report) == list(range(1, 9)) and report[8] == 1 and report[probes] >= 0.9
    some = every.where("query_id % 100 = 0")
    exact = {}
    for r in search_batch(index.store, some, 10).collect():
        exact.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(exact[str(r["query_id"])] & {h["id"] for h in index.search(list(r["vector"]), 10, 2).collect()}) for r in some.collect())
    two = {r["probes"]: r["recall"] for r in index.recall(some).collect()}[2]
    assert abs(hits / sum(map(len, exact.values())) - two) < 1e-9
    q = queries._vector(spark, folder)
    scan = index.probed(q, 2)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and 0 < scan.count() < index.rows.count() == index.store.rows.count()
    assert index.search_routed(q, condition=f.eq("label", 3))[0] == "FLAT" and index.search_routed(q, flat_below=10)[0] == "IVF"


def test_searches_without_k_have_no_limit(spark):
    from stellate.operators.search import search_by_vector

    store = queries._emb(spark, FOLDER)
    assert search_by_vector(store, queries._vector(spark, FOLDER), None).count() == store.live().count()
    for name in ("topk_zero_vector", "topk_min_score_cosine", "topk_max_distance_l2"):
        assert "Limit" not in queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("metric", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_both_routes_are_exact(spark, metric):
    import numpy as np
    from stellate.operators import filters as f
    from stellate.operators.ivf import IvfIndex
    from stellate.operators.search import search_by_vector
    from stellate.plans.definition import StoreDefinition
    from stellate.store import VectorStore

    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)) * 0.4 + (rng.normal(size=(8, 6)) * 3)[rng.integers(0, 8, 400)]
    v[[5, 6, 300]] = 0
    v[200:210] = v[20]  # ties
    docs = spark.createDataFrame([(str(k), k, [float(x) for x in row], k % 3) for k, row in enumerate(v)], "id string, seq long, vector array<float>, label int")
    index = IvfIndex.build(VectorStore.from_documents(docs, StoreDefinition("m", 6, metric, indexed={"label": "int"})), lists=12)
    for q in ([float(x) for x in v[20]], [float(x) for x in rng.normal(size=6)], [0.0] * 6):
        for condition, k in ((None, 10), (f.eq("label", 1), 40)):
            route, hits = index.search_routed(q, k, condition, probes=1, flat_below=10)
            assert route == "IVF" and hits.collect() == search_by_vector(index.store, q, k, condition=condition, payload=False).collect()
    q = [float(x) for x in v[20]]
    worst = index.search_exact(q, 5).collect()[-1]["score"]
    assert 0 < len(index.able_lists(q, worst)) < 12 or metric == "DOT_PRODUCT"
