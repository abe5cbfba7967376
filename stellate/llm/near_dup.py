"""Near-duplicates: ProbMinHash signatures of weighted shingles, banding, exact verification, components.

1. A text's shingles are its runs of ``SHINGLE`` words; a shorter text's one shingle is all of its words.
   A shingle met n times weighs 1 + ln(n).
2. ProbMinHash: each shingle is a Poisson process with its weight as rate; its arrivals fall on registers
   at random, each register keeps the shingle of its first arrival, and a process stops once it is later
   than every register of its text.  Two texts agree in a register with their probability Jaccard.  A text
   that repeats a shingle gets a second signature with the same processes at weight 1, whose registers agree
   with the Jaccard of the sets; the two signatures of other texts are equal.
3. Banding: ``BANDS`` bands of ``ROWS`` registers of each signature.  Texts that share a band key are linked to the one with
   the least digest there, so a key's group is never expanded; components of these links are *groups*, and
   any two texts that share a key are in one group.
4. Verification is exact, by Jaccard of the sets of shingles, in units of about ``BLOCK`` texts that one
   task compares.  No pair of rows is emitted: a task returns the links that join what its earlier links
   have not.  First each text meets the head that it shares most keys with, and others of that head;
   components of these links are classes already.  Then, in groups that are still several classes, texts
   sorted by their number of shingles are cut into blocks, and pairs of blocks are compared, but for those
   within one large class and those whose sizes rule out the similarity.  In a group of so many blocks that
   this would take a text more often than it has keys, the sets of texts by key are treated so instead.
5. Components of the links of both passes are the classes.

At a similarity of 0.8 two texts share none of 32 bands of 5 registers at weight 1 with a probability of
(1 - 0.8**5)**32 = 3e-6, however often either repeats a shingle.  Equal texts are told by digest and go through steps 2 to 5 once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, arrow_map, joined, mix, shuffle_partitions, span_hashes, text_blocks, window_hashes, word_spans, written
from .components import connected_components

SHINGLE, BANDS, ROWS, BLOCK = 5, 32, 5, 256
THRESHOLD = 0.8


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block: hash, text number, times met; ordered by text, then hash."""
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    h, o, _ = window_hashes(words, owner, size)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    for k in np.flatnonzero((count > 0) & (count < size)):
        whole = np.zeros(1, U64)
        for w in words[first[k] : first[k] + count[k]]:
            whole = mix(whole ^ w)
        h, o = np.append(h, mix(whole ^ U64(count[k]))), np.append(o, k)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def prob_minhash(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, registers: int, seed: int = 1) -> np.ndarray:
    """Signatures (n x registers) of weighted sets; a text without elements has zeros.

    All processes advance together; late rounds, with few processes left, take many arrivals at once.
    """
    first = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, U64)
    time = np.zeros(len(h))
    state = mix(h ^ U64(seed))
    active = np.arange(len(h))
    while len(active):
        steps = int(np.clip(16384 // len(active), 1, 64))
        draws = state[active][:, None] + U64(0x9E3779B97F4A7C15) * np.arange(1, steps + 1, dtype=U64)[None, :]
        state[active] = draws[:, -1]
        draws = mix(draws)
        gap = -np.log(((draws >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight[active][:, None]
        arrival = time[active][:, None] + np.cumsum(gap, axis=1)
        register = (mix(draws ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(registers)).astype(np.int64)
        slot = (owner[active][:, None] * registers + register).ravel()
        when, who = arrival.ravel(), np.repeat(active, steps)
        early = when < first[slot]
        slot, when, who = slot[early], when[early], who[early]
        np.minimum.at(first, slot, when)
        won = when == first[slot]
        signature[slot[won]] = h[who[won]]
        time[active] = arrival[:, -1]
        latest = first.reshape(n, registers).max(axis=1)
        active = active[time[active] < latest[owner[active]]]
    return signature.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(signature), bands)).copy()
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key


def text_keys(h: np.ndarray, owner: np.ndarray, times: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x 2 * bands) of both signatures of each text, and which of them count: each once, none without shingles."""
    keys = band_keys(prob_minhash(h, owner, 1 + np.log(times), n, bands * rows), bands, rows)
    repeats = np.bincount(owner, times > 1, minlength=n) > 0
    at = repeats[owner]
    number = np.cumsum(repeats) - 1
    plain = keys.copy()
    if at.any():
        plain[repeats] = band_keys(prob_minhash(h[at], number[owner[at]], np.ones(int(at.sum())), int(repeats.sum()), bands * rows), bands, rows)
    some = np.bincount(owner, minlength=n) > 0
    return np.hstack([plain, keys]), np.hstack([np.broadcast_to(some[:, None], keys.shape), keys != plain])


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, digest, n_shingles, keys`` of every row; texts without a word have no keys."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            n = last - first
            h, owner, times = shingles(data, offsets)
            keys, own = text_keys(h, owner, times, n, bands, rows)
            count = np.bincount(owner, minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own.sum(axis=1))]), pa.int32()), pa.array(keys[own].view(np.int64)))
            yield {"doc_id": batch.column(0)[first:last], "digest": batch.column(2)[first:last], "n_shingles": pa.array(count), "keys": lists}

    return arrow_map(docs, "doc_id long, digest binary, n_shingles long, keys array<long>", run)


def _links(lists: list[np.ndarray], side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """A forest of links between texts whose sets of shingles have at least the Jaccard ``threshold``.

    With ``side`` only pairs of different sides are compared.  Intersections of all pairs come from
    products of slices of the incidence matrix, over the shingles that more than one text has.
    """
    n = len(lists)
    size = np.array([len(x) for x in lists])
    _, index, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    where = np.repeat(np.arange(n), size)
    shared = times[index] > 1
    index, where = index[shared], where[shared]
    _, index = np.unique(index, return_inverse=True)
    order = np.argsort(index, kind="stable")
    index, where = index[order], where[order]
    common = np.zeros((n, n), np.float32)
    width = int(index[-1]) + 1 if len(index) else 0
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(index, [a, a + 4096])
        x = np.zeros((n, min(4096, width - a)), np.float32)
        x[where[lo:hi], index[lo:hi] - a] = 1
        common += x @ x.T
    similar = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-4
    similar &= common > 0
    if side is not None:
        similar &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` (digests) within units of rows ``unit, side, digest, text``, ordered by unit in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, digests, sides, lists = None, [], [], []

        def close() -> pa.RecordBatch:
            side = np.array(sides) if len({*sides}) > 1 else None
            found = _links(lists, side, threshold)
            return pa.RecordBatch.from_pydict({"a": pa.array([digests[i] for i, _ in found], pa.binary()), "b": pa.array([digests[j] for _, j in found], pa.binary())})

        for batch in batches:
            units, of_side, of_digest = (batch.column(k).to_pylist() for k in range(3))
            for first, last, data, offsets in text_blocks(batch.column(3)):
                h, owner, _ = shingles(data, offsets)
                cuts = np.searchsorted(owner, np.arange(last - first + 1))
                for k in range(last - first):
                    at = first + k
                    if units[at] != unit:
                        if len(lists) > 1:
                            yield close()
                        unit, digests, sides, lists = units[at], [], [], []
                    digests.append(of_digest[at]), sides.append(of_side[at]), lists.append(h[cuts[k] : cuts[k + 1]])
        if len(lists) > 1:
            yield close()

    return members.mapInArrow(run, "a binary, b binary")


def _digest(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _near_heads(stars: DataFrame, block: int) -> DataFrame:
    """Units ``node, unit, side`` of texts with the head that they share most keys with, about ``block`` texts each."""
    best = stars.groupBy("digest").agg(F.max(F.struct("shared", "head")).alias("best")).select("digest", F.col("best.head").alias("head"))
    best = written(best, "best")
    chunks = best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"), F.count(F.lit(1)).alias("n"))
    dealt = joined(best, written(chunks, "chunks"), "head", best.count()).select("digest", "head", F.pmod(F.xxhash64("digest"), F.col("chunks")).alias("chunk"))
    both = dealt.select(F.col("digest").alias("node"), "head", "chunk").union(dealt.select("head", "head", "chunk").distinct())
    return both.select("node", F.xxhash64("head", "chunk").alias("unit"), F.lit(0).alias("side"))


def _blocks(members: DataFrame, first: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """``component, node, n_shingles, at`` of ``members`` (``node, component``) in components of several classes.

    ``at`` is a lane and the number of a block of it.  A class of at least ``block`` texts is a lane of its
    own; the other texts of a component share a lane.
    """
    known = first.withColumnRenamed("component", "class")
    large = known.groupBy("class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= block).select("class", F.lit(True).alias("large"))
    sized = members.join(known, "node", "left").join(large, "class", "left").join(texts.select(F.col("digest").alias("node"), "n_shingles"), "node")
    sized = sized.select("component", "node", "n_shingles", F.coalesce("class", "node").alias("class"), F.when(F.col("large"), F.col("class")).otherwise(F.lit(b"")).alias("lane"), F.pmod(F.xxhash64("node"), F.lit(64)).alias("salt"))
    sized = written(sized, "sized")
    apart = sized.groupBy("component").agg((F.min("class") < F.max("class")).alias("apart"), F.count(F.lit(1)).alias("n")).where("apart").select("component", "n")
    sized = joined(sized, written(apart, "apart"), "component", sized.count())
    # A lane's blocks get their numbers from counts by size, not from a sort of the lane.
    cells = sized.groupBy("component", "lane", "n_shingles", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("component", "lane").orderBy("n_shingles", "salt")) - F.col("c")
    cells = cells.select("component", "lane", "n_shingles", "salt", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("component", "lane", "n_shingles", "salt").orderBy("node")) - 1
    blocks = sized.withColumn("place", place).join(cells, ["component", "lane", "n_shingles", "salt"])
    at = F.struct("lane", F.floor((F.col("before") + F.col("place")) / block).cast("int").alias("block")).alias("at")
    return written(blocks.select("component", "node", "n_shingles", at), "blocks")


def _wide(blocks: DataFrame, most: int) -> DataFrame:
    """``component, n`` (its rows) of components with over ``most`` pairs of blocks for each block, told by the lanes' lengths."""
    lanes = blocks.groupBy("component", F.col("at.lane").alias("lane")).agg((F.max("at.block") + 1).cast("double").alias("b"), F.count(F.lit(1)).alias("c"))
    inside = F.sum(F.when(F.col("lane") != F.lit(b""), F.col("b") * (F.col("b") + 1) / 2).otherwise(0.0))
    wide = lanes.groupBy("component").agg(F.sum("b").alias("b"), inside.alias("inside"), F.sum("c").alias("n"))
    return wide.where(F.col("b") * (F.col("b") + 1) / 2 - F.col("inside") > most * F.col("b")).select("component", "n")


def _by_key(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, component`` for each set of ``nodes`` that share a band key; keys of one set count once."""
    banded = written(texts.join(nodes.select(F.col("node").alias("digest")), "digest").select(F.col("digest").alias("node"), F.explode("keys").alias("key")), "banded")
    count = F.count(F.lit(1))
    name = F.concat_ws("-", F.hex(F.bit_xor(F.xxhash64("node"))), F.hex(F.bit_xor(F.xxhash64(F.lit("set"), "node"))), count.cast("string")).cast("binary")
    sets = banded.groupBy("key").agg(name.alias("component"), count.alias("n")).where("n > 1")
    return joined(banded, written(sets, "sets"), "key", banded.count()).select("node", "component").distinct()


def _across(groups: DataFrame, first: DataFrame, texts: DataFrame, threshold: float, block: int, most: int = 2 * BANDS) -> DataFrame:
    """Units ``node, unit, side`` for all pairs of one group that ``first``, the classes so far, leaves apart.

    Groups that are one class need no more comparisons.  In a group whose blocks would be compared over
    ``most`` times each, more than a text has keys, only texts that share a key are: its sets of texts by
    key take the group's place, so a group that is long because it is a chain costs in proportion.
    """
    blocks = _blocks(groups, first, texts, block)
    wide = written(_wide(blocks, most).withColumn("wide", F.lit(True)), "wide")
    if wide.isEmpty():
        return _units(blocks, threshold)
    flagged = written(joined(blocks, wide, "component", blocks.count(), "left"), "flagged")
    by_key = _blocks(_by_key(flagged.where("wide").select("node"), texts), first, texts, block)
    return _units(flagged.where("wide is null").drop("wide"), threshold).union(_units(by_key, threshold))


def _units(blocks: DataFrame, threshold: float) -> DataFrame:
    """Units ``node, unit, side`` for the pairs of blocks of one component; a large class's blocks are not compared with each other."""
    spans = blocks.groupBy("component", "at").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    # Pairs of blocks of one group whose sizes allow the similarity: |small| >= threshold * |large|.
    other = spans.select("component", F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # A group with many blocks is cut into chunks of them, each of which meets all of the group's blocks.
    chunks = spans.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("chunks"))
    spans = spans.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("at"), F.col("chunks")).cast("int"))
    other = other.join(chunks, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = spans.join(other, ["component", "chunk"]).where((F.col("at") <= F.col("at2")) & (F.col("high") >= threshold * F.col("low2") - 1e-6) & (F.col("high2") >= threshold * F.col("low") - 1e-6))
    pairs = pairs.where((F.col("at.lane") != F.col("at2.lane")) | (F.col("at.lane") == F.lit(b"")))
    unit = F.xxhash64("component", "at", "at2").alias("unit")
    sides = pairs.select("component", "at", unit, F.lit(0).alias("side")).union(pairs.where("at < at2").select("component", "at2", unit, F.lit(1).alias("side")))
    return blocks.select("component", "node", "at").join(sides, ["component", "at"]).select("node", "unit", "side")


def _with_texts(members: DataFrame, rows_in: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``unit, side, digest, text`` of ``members``, ordered by unit: one text for each digest that is a member."""
    chosen = members.select("node").distinct().join(texts.select(F.col("digest").alias("node"), "least"), "node")
    bodies = rows_in.join(chosen, (F.col("digest") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])
    compared = members.join(bodies, "node").select("unit", "side", F.col("node").alias("digest"), "text")
    return compared.repartition(n, "unit").sortWithinPartitions("unit", "side", "digest")


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``doc_id, digest, class_id`` for every row: classes are components of links of at least the similarity.

    ``class_id`` is the least ``doc_id`` of the class.  Equal texts are one class whatever their length;
    a null text, or one without a word, is a class of its own.  Repeated rows stay; a null ``doc_id``
    keeps its class, and is its name only if the class has no other.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows_in = rows_in.withColumn("digest", _digest())
    signed = written(_signed(rows_in, bands, rows), "signatures")
    # One row per different text, with its least id.
    texts = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    texts = written(texts, "texts")
    # Links of each band key to its least text, with the number of keys that tell them.
    banded = texts.select("digest", F.explode("keys").alias("key"))
    heads = written(banded.groupBy("key").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    paired = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stars = joined(banded, heads, "key", paired).where("digest <> head").groupBy("head", "digest").agg(F.count(F.lit(1)).alias("shared"))
    stars = written(stars, "stars")
    groups = written(connected_components(stars.select(F.col("head").alias("a"), F.col("digest").alias("b"))), "groups")
    near = written(_verified(_with_texts(_near_heads(stars, block), rows_in, texts, n), threshold), "near")
    first = written(connected_components(near), "first")
    rest = written(_across(groups, first, texts, threshold, block), "rest")
    far = written(_verified(_with_texts(rest, rows_in, texts, n), threshold), "far")
    classes = written(connected_components(near.union(far)), "classes")
    least = classes.join(texts.select(F.col("digest").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n"))
    named = joined(classes, written(least, "least"), "component", classes.count()).select(F.col("node").alias("digest"), "class_id")
    names = texts.select("digest", "least", F.col("copies").alias("n")).join(named, "digest", "left").select("digest", "n", F.coalesce("class_id", "least").alias("class_id"))
    names = written(names, "names")
    # Every row: its text's class, else its own.
    worded = joined(signed.where("n_shingles > 0").select("doc_id", "digest"), names, "digest", signed.count())
    alone = signed.where("n_shingles = 0").select("doc_id", "digest", F.col("doc_id").alias("class_id"))
    return worded.unionByName(alone).select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for every row, as :func:`classes_of` says."""
    return classes_of(docs).select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each class the row with the least ``doc_id`` stays.

    Rows that share both id and text count once; different texts of one class under its least id all stay.
    Columns stay as they are.
    """
    kept = classes_of(docs).where("doc_id <=> class_id").select(F.col("doc_id").alias("_kept"), F.col("digest").alias("_digest")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (_digest() == F.col("_digest"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
