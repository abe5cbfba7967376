"""Each operator against brute force, and on nulls, empty and long texts, ties, empty tables and clashing names."""

import array
import base64
import hashlib
import io
import random
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings, strategies as st

from stellate.llm import components, files, language_id, multiset_hash, near_dup, packing, pii, quality, queries, token_store, tokens, toxicity, transducer, warc_zip
from stellate.llm.common import text_blocks

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, kept int, sequence_id string"


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None, "x", 1, "y") for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id and texts, empty and very long texts, repeated rows; names that clash with added columns."""
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    return rows_of(spark, [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, long), (5, " \n\n "), (None, "a text without an id at all, of nine words"), (7, "héllo wörld\nhéllo wörld\r\n日本語 テキスト 😀")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, folder=SMALL):
    return {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


# ---------------------------------------------------------------- tokens
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(spark, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    assert library.encode("x <|endoftext|> y", add_special_tokens=False).ids.count({"b": 50256, "w": 49407}[name[0]]) == 1
    ours = tokens.ByteLevelIds(P.path(name), P.PATTERN) if name.startswith("byte") else tokens.WordIds(P.path(name), memory=500)
    rng = random.Random(1)
    odd = ["", "<|endoftext|> a", "x <|endoftext|> y", "<|startoftext|>x", "a <|ENDOFTEXT|> <| b", " " * 5000 + "x", "y" * 5000 + "\n" * 4500, "x\x1c y", "a\xa0 b", "ΑΣ Σ", "İ ﬁ ² ½", "it's we'LL", "\n\n  "]
    odd += ["".join(rng.choice([chr(rng.randrange(1, 0xD000)), rng.choice(" \n\t\x85\xa0'sTd0!é")]) for _ in range(30)) for _ in range(1500)]
    for text in [*odd, *list(texts(spark).values())]:
        assert ours(text) == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text


# ---------------------------------------------------------------- 1
def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_places_every_piece(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    library = tokens.tokenizer(P.path("byte_bpe_50k.json"))
    n = check_packing(rows, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d, text in list(texts(spark, MIDDLE).items())[:200]:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[at : at + r["length"]]).tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids) and (len(by[d]) == 1) == (len(ids) <= 1024)


def test_packing_under_every_constraint():
    rng = random.Random(2)
    lengths = Counter(rng.randint(1, 100) for _ in range(3000))
    for rule in ("norm", "dot"):
        capacities = packing.Capacities(128, 3, 10_500)
        patterns = packing.best_fit(lengths, capacities, (1.0, 0.2, 0.2), rule)
        packed = Counter()
        for pattern, count in patterns:
            assert sum(n * k for n, k in pattern) <= 128 and sum(k for _, k in pattern) <= 3 and sum(n * n * k for n, k in pattern) <= 10_500
            for n, k in pattern:
                packed[n] += k * count
        assert packed == lengths
    with pytest.raises(ValueError):
        packing.best_fit({200: 1}, packing.Capacities(128))


def test_packing_odd(spark, odd, none):
    rows = packing.pack_documents(odd, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    check_packing(rows, 1024)
    assert sum(1 for r in rows if r["doc_id"] == 1) == 2 and [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    pieces = packing.token_pieces(odd.where("doc_id > 1"), P.path("byte_bpe_50k.json"), P.PATTERN, 2, 1024)
    whole = packing.sequences(pieces, packing.pack(pieces, ["doc_id", "piece"])).collect()
    assert all(len(r["ids"]) <= 4096 for r in whole)


def test_one_text_of_a_million_blanks(spark):
    docs = rows_of(spark, [(1, " " * 1_000_000), (2, "a word")])
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    check_packing(rows, 1024)
    ids = tokens.tokenizer(P.path("byte_bpe_50k.json")).encode(" " * 1_000_000, add_special_tokens=False).ids + [2]
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(ids)


# ---------------------------------------------------------------- 2
def paragraphs(text):
    out = []
    for line in text.splitlines(keepends=True) if not re.search("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029\r]", text) else re.findall("[^\n]*\n|[^\n]+", text):
        words, end = re.findall(r"[^\S\n]*\S+", line, re.ASCII), re.search(r"[^\S\n]*\n?\Z", line, re.ASCII)[0]
        for at in range(0, len(words), 8):
            last = at + 8 >= len(words)
            out.append("".join(words[at : at + 8]) + (end if last and end.endswith("\n") else ""))
        if not words or not end.endswith("\n"):
            out += [end] if end else []
    assert "".join(out) == text
    return out


def spark_hash(text, seed):
    one = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=one)


def test_fingerprints_and_likeness_are_brute_force(spark):
    every = texts(spark)
    got = {r["doc_id"]: r for r in multiset_hash.edit_likeness(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}

    def brute(text):
        count = Counter(paragraphs(text))
        words = [sum(count.values())] + [sum(n * spark_hash(p, k) for p, n in count.items()) % 2**64 for k in range(multiset_hash.WIDE)]
        lanes = []
        for pack in range(multiset_hash.PACKS):
            hashes = {p: spark_hash(p, 100 + pack) for p in count}
            for k in range(32):
                low, high = (sum(n * (hashes[p] >> (k + part) & 1) for p, n in count.items()) for part in (0, 32))
                words.append(low | high << 32)
                lanes += [low, high]
        return words, 2 * np.array(lanes, float) - words[0]

    def alike(a, b):
        (x, u), (y, v) = a, b
        if x == y:
            return 1.0
        length = np.sqrt(u @ u) * np.sqrt(v @ v)
        return min(1.0, max(0.0, u @ v / length)) if length else 0.0

    order = sorted(every, reverse=True)
    for k, d in enumerate(order):
        text, other = every[d], every[order[(k + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        one, two = brute(text), brute(edited)
        assert got[d]["fingerprint"] == "".join(f"{x:016X}" for x in one[0]) and got[d]["edited_fingerprint"] == "".join(f"{x:016X}" for x in two[0])
        assert abs(got[d]["near_edited"] - alike(one, two)) < 1e-9 and abs(got[d]["near_next"] - alike(one, brute(other))) < 1e-9


def test_next_row_is_brute_force_with_tied_and_null_ids(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    mixed = [(None if rng.random() < 0.2 else 7 if rng.random() < 0.4 else rng.randrange(300), f"t{rng.randrange(10**6)}") for _ in range(1500)] + [(None, None), (5, "")]
    for rows in (mixed, [(7, f"x{k}") for k in range(300)], [(None, f"x{k}") for k in range(300)], [(1, "a")]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = multiset_hash.with_next(frame, ["text", "doc_id"], 32).collect()
        h = {r[0]: r[1] for r in frame.select("text", F.xxhash64("text")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]]))
        assert sorted(str((*order[k], *order[(k + 1) % len(order)])) for k in range(len(order))) == sorted(str((r["doc_id"], r["text"], r["next_doc_id"], r["next_text"])) for r in got)


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in multiset_hash.edit_likeness(docs).collect()}
    every = texts(spark)
    order = sorted(every, reverse=True)
    for k, d in enumerate(order):
        text, other = every[d], every[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[d]["n_chars"] == len(text) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len({r["fingerprint"] for r in got.values()}) >= len({*every.values()}) - 1
    near = [r["near_edited"] for r in got.values()]
    assert np.mean(near) > np.mean([r["near_next"] for r in got.values()]) + 0.4 and all(0 <= x <= 1 for x in near)
    assert multiset_hash.edit_likeness(odd).count() == 8 and multiset_hash.edit_likeness(none).count() == 0


def test_fingerprint_is_a_homomorphism(spark):
    from pyspark.sql import functions as F

    a, b = "first line\nsecond line here\n", "third\nfirst line\n"
    row = spark.createDataFrame([(a, b, b + a, a + b)], "a string, b string, ba string, ab string")
    fp = multiset_hash.fingerprint
    out = row.select(fp(F.col("ab")).alias("ab"), fp(F.col("ba")).alias("ba"), multiset_hash.added(fp(F.col("a")), fp(F.col("b"))).alias("s"), multiset_hash.deleted(multiset_hash.inserted(fp(F.col("a")), F.lit("third\n")), F.lit("third\n")).alias("back"), fp(F.col("a")).alias("a"), multiset_hash.inserted(fp(F.col("a")), F.lit("x\n")).alias("x"), fp(F.concat("a", F.lit("x\n"))).alias("ax")).first()
    assert out["ab"] == out["ba"] == out["s"] and out["back"] == out["a"] and out["x"] == out["ax"]


def test_fingerprints_of_many_paragraphs(spark):
    from pyspark.sql import functions as F

    blank, words = "\n" * 100_000, " ".join(f"w{k}" for k in range(1_000_000))
    docs = rows_of(spark, [(3, blank), (2, words), (1, "\n" * 50_000)])
    got = {r["doc_id"]: r for r in multiset_hash.edit_likeness(docs).collect()}
    assert got[1]["near_next"] > 0.999 and got[3]["near_next"] < 0.4 and got[2]["near_edited"] < 0.4  # cosine 0.004: 50,000 equal lines outweigh
    for d, text in ((3, blank), (2, words)):
        pieces = spark.createDataFrame([(text,)], "text string").select(F.explode(multiset_hash.paragraphs(F.col("text"))).alias("p")).groupBy("p").count()
        rows = pieces.select("count", multiset_hash.paragraph_vector(F.col("p")).alias("v")).collect()
        v = np.array([r["v"] for r in rows]).view(np.uint64)
        want = (v * np.array([r["count"] for r in rows], np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)
        assert got[d]["fingerprint"] == "".join(f"{int(x):016X}" for x in want)
        low, high = v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)
        lanes = slice(1 + multiset_hash.WIDE, None)
        assert (low[:, lanes] <= 1).all() and (high[:, lanes] <= 1).all()


# ---------------------------------------------------------------- 3
def test_token_store(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest = token_store.write_store(docs, P.path("word_bpe_49k.json"), shard_limit=20_000)
    assert manifest.count() > 4
    library, at = tokens.tokenizer(P.path("word_bpe_49k.json")), 0
    for r in sorted(token_store.read_store(spark, manifest).collect()):
        ids = library.encode(texts_cache(spark)[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        at += len(ids)
    found = token_store.lookup(manifest, spark.createDataFrame([(5,), (77,), (10**9,), (None,)], "doc_id long")).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {d: library.encode(texts_cache(spark)[d], add_special_tokens=False).ids + [1] for d in (5, 77)}
    rows = token_store.read_store(spark, token_store.write_store(odd, P.path("word_bpe_49k.json"))).collect()
    assert len(rows) == 8 and [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1] and min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert token_store.read_store(spark, token_store.write_store(none, P.path("word_bpe_49k.json"))).count() == 0


def test_token_store_of_one_id_and_of_wide_ids(spark):
    docs = rows_of(spark, [(7, f"text number {k}") for k in range(300)] + [(9, "last")])
    manifest = token_store.write_store(docs, P.path("word_bpe_49k.json"), shard_limit=600)
    rows = token_store.read_store(spark, manifest).collect()
    assert manifest.count() > 3 and len(rows) == 301 and max(rows, key=lambda r: r["start"])["doc_id"] == 9
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))  # noqa: B905
    assert sorted(r["doc_id"] for r in token_store.lookup(manifest, spark.createDataFrame([(7,), (9,), (8,)], "doc_id long")).collect()) == [7, 9]
    with pytest.raises(ValueError):
        token_store.write_store(docs, P.path("word_bpe_49k.json"), end_id=70_000, width=2)
    wide = token_store.read_store(spark, token_store.write_store(docs.where("doc_id = 9"), P.path("word_bpe_49k.json"), end_id=70_000)).first()
    ids = tokens.tokenizer(P.path("word_bpe_49k.json")).encode("last", add_special_tokens=False).ids + [70_000]
    assert wide["ids_crc32"] == zlib.crc32(array.array("I", ids).tobytes())


def test_attempts_never_share_a_file(tmp_path):
    names = {files.own_name(f"{tmp_path}/shard-0", ".tid") for _ in range(3)}
    for name in names:
        files.put(name, [b"one", b"two"])
    assert len(names) == 3 and all(open(n, "rb").read() == b"onetwo" for n in names) and len({*tmp_path.iterdir()}) == 3


def test_hot_keys_join_like_others(spark):
    from stellate.llm.common import joined

    rows = spark.createDataFrame([("a" if k % 3 == 0 else f"k{k}" if k % 2 else None, k) for k in range(5000)], "key string, v int")
    table = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "concat(key, '!') as name", "n").where("key <> 'k1'")
    for how in ("inner", "left"):
        want = sorted(rows.join(table.drop("n"), "key", how).collect(), key=str)
        assert sorted(joined(rows, table, "key", 5000, how).collect(), key=str) == want == sorted(joined(rows, table, "key", 5000 * 1024, how).collect(), key=str)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace
    from unittest.mock import MagicMock
    from stellate.llm.common import shared_dir

    context = MagicMock(master="yarn")
    context._jsc.sc().getCheckpointDir().isDefined.return_value = False
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context), "x")


_cache = {}


def texts_cache(spark):
    if not _cache:
        _cache.update(texts(spark))
    return _cache


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000])
def test_hash_index_is_minimal_and_perfect(n):
    keys = np.array(random.Random(n).sample(range(-(10**12), 10**12), n), dtype=np.int64)
    pilots, slots = token_store.build_index(keys)
    assert sorted(slots) == list(range(n))
    if n:
        h = token_store._key_hashes(keys)
        assert (token_store._slots_of(h, pilots[(h % np.uint64(len(pilots))).astype(int)], n) == slots).all()


# ---------------------------------------------------------------- 4
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(every):
    sets = {d: shingles(t) for d, t in every.items()}
    parent = {d: d for d in every}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(every)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in every}


def test_near_duplicates_are_brute_force(spark, odd, none):
    rng = random.Random(5)
    every = dict(list(texts(spark).items())[:80])
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(400):  # chains of copies that drift apart: more than one block
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        every[1000 + k] = " ".join(words)
    every |= {2000: None, 2001: "", 2002: "", 2003: "short text", 2004: "short text", 2005: "other text"}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes_of(rows_of(spark, every.items()), block=64).collect()}
    assert got == brute_classes(every)
    assert near_dup.near_duplicates(odd).count() == 8 and near_dup.near_duplicates(none).count() == 0
    kept = near_dup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_near_duplicates_that_repeat_unequally(spark):
    rng, every = random.Random(11), {}
    for k in range(0, 300, 2):  # pairs at a set Jaccard just over 0.8, of which one repeats a third of it 40 times
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        every[k] = " ".join(words + words[:90] * 40)
        every[k + 1] = " ".join(words[:-29] + [f"x{rng.randrange(10**9)}" for _ in range(29)])
        one, two = shingles(every[k]), shingles(every[k + 1])
        assert 0.8 <= len(one & two) / len(one | two) < 0.82
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes_of(rows_of(spark, every.items())).collect()}
    assert got == {d: d - d % 2 for d in every}


def test_second_pass_covers_what_the_first_leaves_apart(spark):
    node = {k: bytes([k]) for k in range(1, 13)}
    group = {k: 1 if k <= 9 else 10 for k in node}  # two groups: 1 to 9, and 10 to 12, which is one class already
    label = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 10: 10, 11: 10, 12: 10}  # 7 to 9 are in no class
    groups = spark.createDataFrame([(node[k], node[g]) for k, g in group.items()], "node binary, component binary")
    first = spark.createDataFrame([(node[k], node[c]) for k, c in label.items()], "node binary, component binary")
    table = spark.createDataFrame([(node[k], 100) for k in node], "digest binary, n_shingles long")
    units = {}
    for r in near_dup._across(groups, first, table, 0.8, 2).collect():
        units.setdefault(r["unit"], []).append((r["node"][0], r["side"]))
    covered = set()
    for rows in units.values():
        two = len({side for _, side in rows}) > 1
        covered |= {(a, b) for a, x in rows for b, y in rows if a < b and not (two and x == y)}
    want = {(a, b) for a in range(1, 10) for b in range(a + 1, 10) if label.get(a, a) != label.get(b, b)}
    assert covered == want


def test_wide_groups_are_compared_by_key(spark, monkeypatch):
    """Chains of copies, each near the next ones alone, are one group of very many classes' worth of blocks."""
    rng, every = random.Random(23), {}
    words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    for k in range(320):  # of neighbours some are at 0.8, others just below
        start = sum(6 + (j * 7) % 5 for j in range(k))
        every[k] = " ".join(words[start : start + 74]) if start + 74 <= 3000 else words[k]
    every |= {1000 + k: " ".join(["a", "b", "c", "d", f"e{k % 7}", "f", "g", "h"]) for k in range(20)}
    seen, by_key = [], near_dup._by_key
    monkeypatch.setattr(near_dup, "_by_key", lambda nodes, table: seen.append(nodes.count()) or by_key(nodes, table))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes_of(rows_of(spark, every.items()), block=2).collect()}
    assert got == brute_classes(every) and len(set(got.values())) > 50
    assert seen and seen[0] > 250


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 2**60, 300).astype(np.uint64), rng.integers(1, 2**60, 100).astype(np.uint64)
    x, y = {int(h): 1 + i % 3 for i, h in enumerate(a)}, {int(h): 1 + (i * 7) % 4 for i, h in enumerate([*a[:220], *b])}
    h, owner = np.array([*x, *y], np.uint64), np.array([0] * len(x) + [1] * len(y))
    s = near_dup.prob_minhash(h, owner, np.array([*x.values(), *y.values()], float), 2, 4096)
    both = x.keys() & y.keys()
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in both)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 103: 100}


# ---------------------------------------------------------------- 5
def test_language_accuracy_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_id.fit(language_id.train_rows(docs))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    mixed = rows_of(spark, [(1, "the and of with that this " * 10 + "nicht und der die einen werden " * 10)])
    assert [s["lang"] for s in language_id.predict(mixed, model).first()["spans"]] == ["en", "de"]
    marks = rows_of(spark, [(1, "²"), (2, "½ ½"), (3, "Ⅷ 12 _"), (4, "привет мир"), (5, "the²and of½with"), (6, "the and of with")])
    seen = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(marks, model).collect()}
    assert [seen[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and seen[4][0] in model["langs"] and seen[4][1] == 0 and seen[5] == seen[6] == ("en", 1.0)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (2, 3, 5)] == ["und"] * 3 and len(got) == 7
    empty = language_id.fit(language_id.train_rows(none))
    assert language_id.predict(odd, empty).where("lang_pred <> 'und'").count() == 0 and language_id.predict(none, model).count() == 0


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 3, 6, 1])
    s = rng.normal(size=(15, 3)).astype(np.float32)
    got, at = language_id.viterbi(s, lengths, 0.8), 0
    from itertools import product

    for n in lengths:
        if n:
            part = s[at : at + n]
            worth = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023,B905
            assert abs(worth(tuple(got[at : at + n])) - max(map(worth, product(range(3), repeat=int(n))))) < 1e-4
        at += n


# ---------------------------------------------------------------- 6
@given(st.integers(2, 10**12), st.data())
@settings(max_examples=60, deadline=None)
def test_feistel_is_a_permutation(size, data):
    p = pii.Feistel(b"k")
    x, y = data.draw(st.integers(0, size - 1)), data.draw(st.integers(0, size - 1))
    assert 0 <= p(x, size, "t") < size and (p(x, size, "t") == p(y, size, "t")) == (x == y)


def test_small_domains_are_permuted_whole():
    for size in (2, 10, 97, 365):
        assert sorted(pii.Feistel(b"q")(k, size, "t") for k in range(size)) == list(range(size))


def test_pseudonyms_keep_their_format(spark, odd, none):
    text = "Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; call +1 (017) 555-7713, mail Jo.Doe_7@mail.example.com, from 10.1.2.250, born 1984-02-29 or 29/02/1984, ssn 123-45-6789, DE89 3704 0044 0532 0130 00."
    out = {r["doc_id"]: r for r in pii.pseudonymize(rows_of(spark, [(1, text), (2, "again 4111111111111111.")]), b"k").collect()}
    new = out[1]["text"]
    assert [s["kind"] for s in out[1]["private_spans"]] == ["card", "card", "phone", "email", "ip", "date", "date", "ssn", "iban"]
    for old in ("4111 1111", "4111111111111111", "555-7713", "Jo.Doe_7", "10.1.2.250", "1984-02-29", "123-45-6789", "3704 0044"):
        assert old not in new
    assert "4111111111111112" in new
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t)))
    plain = lambda t: re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", t)
    assert shape(plain(new)) == shape(plain(text))
    card = re.search(r"or (\d{16})", new).group(1)
    assert pii.luhn_digit(card[:-1]) == card[-1] and card in out[2]["text"] and card == re.search(r"Card ([\d ]{19})", new).group(1).replace(" ", "")
    got = pii.pseudonymize(odd, b"k")
    assert {*odd.columns} < {*got.columns} and got.count() == 8 and pii.pseudonymize(none, b"k").count() == 0
    for key in (b"", None):
        with pytest.raises(ValueError):
            pii.pseudonymize(odd, key)


def planted(rng):
    """A text, the spans of the personal data in it, and their kinds; between these are words and values that fail their validation."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good=True):
        d = digits(15)
        d = f"4{d[1:]}"
        d += str((int(pii.luhn_digit(d)) + (not good)) % 10)
        return " ".join(d[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.5 else d

    def iban(good=True):
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # DE
        text = f"DE{check if good else (check - 1 or 97):02d}{body}"
        return " ".join(text[k : k + 4] for k in range(0, 22, 4)) if good and rng.random() < 0.5 else text  # groups of a broken one may be a card number

    ip = lambda good=True: ".".join(str(rng.randrange(256) if good else rng.randrange(256, 999)) for _ in range(4))
    date = lambda good=True: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13) if good else 13:02d}-{rng.randrange(1, 29):02d}"
    slashed = lambda good=True: f"{rng.randrange(1, 29) if good else 33:02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1900, 2100)}"
    ssn = lambda good=True: f"{rng.choice(['123', '551', '899']) if good else rng.choice(['000', '666', '900'])}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    email = lambda good=True: f"{rng.choice(['jo', 'a.b-c', 'x_9%', 'Q+1'])}@{rng.choice(['mail', 'a-b.c'])}.{rng.choice(['org', 'de', 'museum']) if good else rng.choice(['1', 'x', '42'])}"
    phone = lambda good=True: rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]) if good else f"{digits(3)}-{digits(4)}"
    makers = [("card", card), ("iban", iban), ("ip", ip), ("date", date), ("date", slashed), ("ssn", ssn), ("email", email), ("phone", phone)]
    text, spans = "", []
    for _ in range(rng.randrange(1, 12)):
        text += rng.choice(["see", "né à", "x;", "(a)", "über:"]) + rng.choice([" ", "\n", ", "])
        kind, make = rng.choice(makers)
        good = rng.random() < 0.7
        value = make(good)
        if good:
            spans.append((len(text), len(text) + len(value), kind))
        text += value + rng.choice([" ", ", ", "; ", "\n", ") ", "! "])
    return text, spans


def test_exactly_what_is_planted_is_found():
    rng = random.Random(17)
    for _ in range(1500):
        text, spans = planted(rng)
        assert [x[:3] for x in pii.find(text, pii.Feistel(b"k"))] == spans, text


def test_values_in_documents_are_found_word_by_word(spark):
    """Every word that other validations call an address, a date or a card is found, and nothing else of these kinds is."""
    import datetime
    import ipaddress

    def kind_of(w):
        try:
            if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", w) and ipaddress.ip_address(w):
                return "ip"
            if re.fullmatch(r"\d{4}-\d\d-\d\d", w) and 1900 <= datetime.date.fromisoformat(w).year < 2100:
                return "date"
        except ValueError:
            return None
        if re.fullmatch(r"\d{13,19}", w) and (sum(map(int, w[-1::-2])) + sum(sum(map(int, str(2 * int(d)))) for d in w[-2::-2])) % 10 == 0 and w.strip("0"):
            return "card"
        return "email" if re.fullmatch(r"[A-Za-z0-9.+_%-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", w) else None

    seen = Counter()
    for text in texts(spark, MIDDLE).values():
        want = Counter((k, w) for w in (x.strip(".-+%/") for x in re.split(r"[^\w.@%+/-]+", text or "")) if (k := kind_of(w)))
        found = Counter((k, text[a:b]) for a, b, k, _ in pii.find(text or "", pii.Feistel(b"k")) if k in ("ip", "email") or (k == "date" and "-" in text[a:b]) or (k == "card" and text[a:b].isdigit()))
        assert found == want, text
        seen.update(k for k, _ in want.elements())
    assert len(seen) >= 2


def test_long_texts_take_time_in_proportion():
    rng = random.Random(1)
    digits = "".join(rng.choice("0123456789abcdef") for _ in range(1_000_000))
    addresses = " ".join(f"user{k}@mail{k % 9}.example.com" for k in range(20_000))
    for text, n in (("@" + digits, 0), (digits + "@example.com", 1), (addresses, 20_000), ("a@" + "1." * 200_000, 0), ("1" * 1_000_000, 0)):
        began = time.perf_counter()
        found = pii.find(text, pii.Feistel(b"k"))
        assert len(found) == n and time.perf_counter() - began < 20
        if n == 1:
            new = found[0][3]
            assert len(new) == len(text) and all(new[k : k + 64] != text[k : k + 64] for k in range(0, 900_000, 64))
    one, two = (pii.find("ab" * 400 + end + "@x.com", pii.Feistel(b"k"))[0][3] for end in ("c", "d"))
    assert one[:768] == two[:768] and one[768:] != two[768:] and all(one[k : k + 64] != "ab" * 32 for k in range(0, 768, 64))


def test_ibans_before_words_and_dates_before_times():
    for iban, after in (("ES91 2100 0418 4502 0005 1332", " BIC"), ("BE68 5390 0754 7034", " EUR"), ("BE68539007547034", " 100"), ("BE68 5390 0754 7034", " DE89 3704 0044 0532 0130 00")):
        found = pii.find(f"to {iban}{after}", pii.Feistel(b"k"))
        assert found[0][:3] == (3, 3 + len(iban), "iban") and found[0][3] != iban
        assert [k for _, _, k, _ in found] == ["iban"] * (2 if "DE89" in after else 1)
    assert [x[:3] for x in pii.find("AB12 CDEF BE68 5390 0754 7034 EUR", pii.Feistel(b"k"))] == [(10, 29, "iban")]
    assert [x[:3] for x in pii.find("at 2024-02-29T10:15:00Z, 2024-02-29Tx", pii.Feistel(b"k"))] == [(3, 13, "date")]


# ---------------------------------------------------------------- 7
def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    covered = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    for r in rows:
        assert tuple(r[c] for c in quality.BASE) == brute_base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    got = quality.score(odd, None)
    assert sorted({*got.columns} & {"kept", "n_words"}) == ["kept", "n_words"] and got.columns.count("kept") == 1
    for r in got.collect():
        assert tuple(r[c] for c in quality.BASE) == brute_base(r["text"])
    assert quality.score(none, None).count() == 0 and quality.fit(none, labels) is None


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def polynomial(data):
    return sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, k, 2**64) for k, b in enumerate(data)) % 2**64


def test_quality_of_rows_kept_out_and_by_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").collect()
    told = [r for r in rows if not r["base_failed"]]
    for value in (0, 1):
        some = [r["kept"] == bool(value) for r in told if r["quality"] == value]
        assert len(some) > 50 and np.mean(some) > 0.97
    p = np.array([r["quality_probability"] for r in told])
    assert abs(p.mean() - np.mean([r["quality"] for r in told])) < 0.05  # calibrated
    weight = dict(zip(np.frombuffer(model["at"], np.int32).tolist(), np.frombuffer(model["weights"], np.float32).astype(float).tolist(), strict=True))
    for r in rows[:40]:
        data = r["text"].encode()
        words = [mixed((polynomial(w) + mixed(len(w))) % 2**64) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
        families = [words, [mixed(mixed(a) ^ b) for a, b in zip(words, words[1:])], [mixed(data[k] | data[k + 1] << 8 | data[k + 2] << 16) for k in range(len(data) - 2)]]  # noqa: B905
        z = model["intercept"]
        for k, hashes in enumerate(families):
            z += sum(weight.get((mixed(h ^ (k + 1)) >> (64 - quality.BITS)) + (k << quality.BITS), 0.0) for h in hashes) / max(len(hashes), 1)
        assert abs(r["quality_probability"] - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-6
    again = docs.union(docs).union(docs)
    assert quality.sampled_texts(again, quality.sampled_ids(labels, "quality", 70, 7)).count() == 70


@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_base_counts_by_chance(some):
    for _, _, data, offsets in text_blocks(pa.array(some)):
        found = quality.base_counts(data, offsets)
        assert list(zip(*(found[c].tolist() for c in quality.BASE), strict=True)) == [brute_base(t) for t in some]


# ---------------------------------------------------------------- 8
RANKS = transducer.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = transducer.Encoder(RANKS, P.PATTERN, memory=500)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_transducer_is_the_library(text):
    assert OURS(text) == array.array("I", LIBRARY.encode_ordinary(text)).tobytes()


def test_round_trip(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    encoded = transducer.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    back = sorted((str(r["doc_id"]), r["text"]) for r in transducer.decode(encoded, P.path("byte_bpe_multi_50k.tiktoken")).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    by = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id > 10").collect()}
    for r in transducer.round_trip_digests(docs.where("doc_id > 10"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        ids = LIBRARY.encode_ordinary(by[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(by[r["doc_id"]].encode()).hexdigest())
    assert transducer.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_pieces():
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.perf_counter()
    assert OURS(letters) == array.array("I", LIBRARY.encode_ordinary(letters)).tobytes()
    blank = OURS(" " * 1_000_000)
    assert b"".join(transducer.Decoder(RANKS).blocks(np.frombuffer(blank, "<u4"))) == b" " * 1_000_000
    assert time.perf_counter() - began < 30 and not any(len(k) > tokens.LONGEST_KEY for k in OURS.chunks)
    small = transducer.Transducer(RANKS, limit=50)
    assert small.encode(letters[:20_000].encode()) == array.array("I", LIBRARY.encode_ordinary(letters[:20_000])).tobytes() and len(small.states) < 5000


def test_states_are_bounded():
    small = transducer.Transducer(RANKS, limit=50)
    for word in (b"internationalisation", b"hippopotamus", b"zzzz", bytes(range(256)), b"the"):
        assert small.encode(word) == np.array(transducer.merged(word, RANKS), "<u4").tobytes()


@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=30))
@settings(max_examples=300, deadline=None)
def test_utf8_machine_may_be_cut_anywhere(data, cuts):
    machine, out, at = transducer.Utf8Machine(), "", 0
    for n in [*cuts, len(data)]:
        out += machine.feed(data[at : at + n])
        at += n
    assert out + machine.finish() == data.decode("utf-8", "replace")


# ---------------------------------------------------------------- 9
def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0").select("doc_id", F_label()), "doc_id").collect()  # rows kept out
    assert np.mean([r["toxic"] for r in rows if r["label"] == 0]) < 0.01 and np.mean([r["toxic"] for r in rows if r["label"] == 1]) > 0.8
    weight = dict(zip(np.frombuffer(model["terms"], np.uint64).tolist(), np.frombuffer(model["weights"]).tolist(), strict=True))
    for r in rows[:300]:
        data = bytearray(r["text"].encode())
        for k, b in enumerate(data):
            if 65 <= b <= 90 or (k and data[k - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
                data[k] += 32
        words = re.findall(rb"[a-z\x80-\xff]+", bytes(data))
        told = {mixed(polynomial(w)) for w in words} | {mixed((polynomial(w[:n]) + n) % 2**64) for w in words for n in toxicity.PREFIXES if len(w) > n}
        z = sum(weight.get(t, 0.0) for t in told)
        over = [1 / (1 + np.exp(np.clip(c - z, -50, 50))) for c in np.frombuffer(model["thresholds"])]
        each = -np.diff([1.0, *over, 0.0])
        assert abs(r["severity"] - sum(over)) < 1e-6 and abs(r["toxic_probability"] - over[0]) < 1e-6 and r["toxic"] == (over[0] >= 0.5) and abs(each[r["grade"]] - max(each)) < 1e-9
    cut = np.frombuffer(model["thresholds"])
    assert (np.diff(cut) > 0).all() and all(0 <= r["severity"] <= len(cut) for r in rows)
    got = toxicity.score(odd, model)
    assert got.columns.count("toxic") == 1 and got.where("not toxic").count() == 8
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels) is None and toxicity.score(odd, None).where("toxic").count() == 0


def F_label():
    from pyspark.sql import functions as F

    return F.col("toxic").alias("label")


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    z = x @ [2.0, -1.0, 0.0, 0.5] + rng.logistic(size=3000)
    grade = np.digitize(z, [-1.0, 1.0, 2.5])
    w, cut = toxicity.fit_ordinal(x, grade, 4)
    assert np.abs(w - [2.0, -1.0, 0.0, 0.5]).max() < 0.3 and np.abs(cut - [-1.0, 1.0, 2.5]).max() < 0.4


# ---------------------------------------------------------------- 10
def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (None, "u", "<p>x</p>"), (2, "v", "<p>x</p>")], "page_id long, url string, html string")
    for wide in (False, True):
        packages = warc_zip.write_archives(pages, package_limit=300, zip64=wide)
        got = warc_zip.read_archives(spark, packages).collect()
        kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
        assert kinds == [("1", "revisit", 2, 8), ("2", "response", None, 8), ("2", "response", None, 8), ("3", "revisit", 4, 0), ("4", "response", None, 0), ("5", "response", None, 100_000), ("None", "revisit", 2, 8)]
        assert {r["payload_digest"] for r in got if r["page_id"] == 5} == {base64.b32encode(hashlib.sha1(("é" * 50_000).encode()).digest()).decode()}
    assert [r["record_type"] for r in warc_zip.read_archives(spark, warc_zip.write_archives(pages.where("page_id < 3"), least_bytes=9)).collect()] == ["response"] * 3
    assert warc_zip.read_archives(spark, warc_zip.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_is_read_by_the_standard_library_and_by_ranges(tmp_path, wide):
    members = [("a.bin", [b"12", b"345"]), ("ü/b", [bytes(1000)])]
    data = b"".join(warc_zip.zip_bytes(members, zip64=wide))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a.bin") == b"12345"
    (tmp_path / "x.zip").write_bytes(data)
    package = warc_zip.Package(str(tmp_path / "x.zip"))
    assert package.read("a.bin", 1, 3) == b"234" and package.read("ü/b") == bytes(1000)
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("c", b"other writer")
        z.comment = b"a comment"
    assert warc_zip.Package(str(tmp_path / "y.zip")).read("c", 6) == b"writer"


# ---------------------------------------------------------------- queries
def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in queries.queries()) == list(range(1, 11))


def test_features_lie_in_a_file():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(3 << quality.BITS, n, replace=False)).astype(np.int32), rng.random(n).astype(np.float32)) for n in (0, 1, 700, 0, 5)]
    for (at, x), (want_at, want_x) in zip(quality.filed(rows), rows, strict=True):
        assert at.dtype == np.int32 and x.dtype == np.float32 and (at == want_at).all() and (x == want_x).all()
    assert quality.filed([]) == [] and [len(a) for a, _ in quality.filed([rows[0]])] == [0]
    tracemalloc.start()
    sparse = quality.filed((np.full(100_000, k, np.int32), np.full(100_000, k, np.float32)) for k in range(50))
    assert tracemalloc.get_traced_memory()[1] < 5e6 and all((at == k).all() and (x == k).all() for k, (at, x) in enumerate(sparse))
    tracemalloc.stop()
