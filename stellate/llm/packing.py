"""Best-fit packing of token pieces into fixed-size training sequences.

An item asks for a vector of tokens, one document place and attention cost (its squared length); each
sequence offers a capacity in every one of them.  Items are taken by falling length, and each goes to the
open sequence with the best score among those where it fits under *every* constraint: the smallest
weighted norm of what would remain (``rule="norm"``) or the largest weighted dot product of demand and
residual (``rule="dot"``).

An item's demand follows from its length alone, so the driver solves the packing over the histogram of
lengths, at most ``capacity`` rows however large the corpus is, and gets *patterns*: a multiset of lengths
and how many sequences have it.  Spark then numbers the items of each length and every item looks up its
sequence and place.  No item passes through the driver, and no task has more than its share of a length.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_map, kept_columns, quoted, shuffle_partitions, written
from .tokens import ByteLevelIds, loaded


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds.  The defaults of the last two never bind before the tokens do."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, size: int) -> DataFrame:
    """Token ids of whole texts with ``end_id`` at the end, cut into pieces of at most ``size``.

    Returns ``doc_id, piece, start, length, ids``.  A document of at most ``size`` ids is one piece.
    Only longer ones are cut, and then the first piece is the shorter one.  Null and empty texts are one
    piece that holds the end id; a null ``doc_id`` is kept; repeated rows give repeated pieces; other
    columns are left out.
    """
    ending = array.array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encode = loaded(vocabulary, lambda: ByteLevelIds(vocabulary, pattern))
        ids_of, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 1000):
            doc, piece, start, length, ids = [], [], [], [], []
            for d, text in zip(ids_of.slice(at, 1000).to_pylist(), texts.slice(at, 1000).to_pylist(), strict=True):
                data = encode(text) + ending
                n = len(data) // 4
                first = n if n <= size else n % size or size
                begins = [0, *range(first, n, size)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    doc.append(d), piece.append(k), start.append(a), length.append(b - a), ids.append(data[4 * a : 4 * b])
            yield {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary())}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, "doc_id long, piece int, start long, length long, ids binary", run)


def best_fit(histogram: dict[int, int], capacities: Capacities = Capacities(), weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times), ...], sequences)`` that hold every item of the histogram once.

    Equal steps are taken at once: all sequences with the same pattern are one group.  Raises on a
    length below 1 or one that no empty sequence can take.
    """
    full = np.array(capacities.vector(), dtype=np.int64)
    weight = np.asarray(weights, float)
    keys: list[tuple[int, int, int]] = []  # residuals of open groups, beside what has them
    groups: dict[tuple[int, int, int], list[list]] = {}

    def add(residual: tuple[int, int, int], pattern: list[tuple[int, int]], count: int) -> None:
        if residual not in groups:
            groups[residual] = []
            keys.append(residual)
        groups[residual].append([pattern, count])

    def extended(pattern: list[tuple[int, int]], length: int, times: int) -> list[tuple[int, int]]:
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + times)]
        return [*pattern, (length, times)]

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (demand > full).any():
            raise ValueError(f"an item of length {length} fits no sequence")
        while left > 0 and keys:
            have = np.array(keys, dtype=np.int64)
            fits = np.flatnonzero((have >= demand).all(axis=1))
            if not len(fits):
                break
            residual, asked = have[fits] / full, demand / full
            score = -(weight * (residual - asked) ** 2).sum(axis=1) if rule == "norm" else (weight * residual * asked).sum(axis=1)
            key = keys[int(fits[int(np.argmax(score))])]
            pattern, count = groups[key][-1]
            used = min(left, count)
            if used == count:
                groups[key].pop()
                if not groups[key]:
                    del groups[key]
                    keys.remove(key)
            else:
                groups[key][-1][1] = count - used
            add(tuple(int(x) for x in np.array(key) - demand), extended(pattern, length, 1), used)
            left -= used
        if left > 0:
            each = int((full // demand).min())
            for times, count in ((each, left // each), (left % each, 1)):
                if times and count:
                    add(tuple(int(x) for x in full - times * demand), [(length, times)], count)
    return [(pattern, count) for found in groups.values() for pattern, count in found]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: length, first rank, end rank, first sequence, items a sequence, first offset."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            rank = taken.get(length, 0)
            taken[length] = rank + times * count
            out.append((length, rank, rank + times * count, sequence, times, offset))
            offset += length * times
        sequence += count
    return out


def pack(items: DataFrame, order: list[str], capacities: Capacities = Capacities(), weights=(1.0, 1e-3, 1e-3), rule: str = "norm", length: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: gapless within each sequence and from 0.

    ``items`` must be cheap to read twice (a written table).  ``order`` names columns that tell the items
    of one length apart; items that tie in all of them are interchangeable.  A null length counts as an
    error, as does one that fits no sequence.  An empty table gives an empty one.  Columns of the input
    named ``sequence_id`` or ``offset`` are replaced.
    """
    spark = items.sparkSession
    size = quoted(length).cast("long")
    histogram = {r[0]: r[1] for r in items.groupBy(size.alias("l")).count().collect()}  # at most `tokens` rows
    if None in histogram:
        raise ValueError("an item has no length")
    slots = places(best_fit(histogram, capacities, weights, rule))
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "_l long, _from long, _to long, _first long, _each long, _at long")
    # Number the items of each length: first within salted buckets, so that no task has a whole length.
    buckets = max(256, 4 * shuffle_partitions(spark))
    dealt = items.select(*[quoted(c) for c in kept_columns(items, ["sequence_id", "offset"])]).withColumn("_b", F.pmod(F.xxhash64(*[quoted(c) for c in order]), F.lit(buckets)).cast("int")).withColumn("_n", size)
    before = dealt.groupBy("_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = before.select("_n", "_b", (F.sum("_c").over(Window.partitionBy("_n").orderBy("_b")) - F.col("_c")).alias("_before"))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_n", "_b").orderBy(*[quoted(c) for c in order])))
    ranked = ranked.join(before, ["_n", "_b"]).withColumn("_rank", F.col("_k") - 1 + F.col("_before"))
    # The table has a row for each length of each pattern, a few thousand at most for any corpus.
    joined = ranked.join(F.broadcast(table), (F.col("_n") == F.col("_l")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    local = F.col("_rank") - F.col("_from")
    return joined.select(
        *[quoted(c) for c in kept_columns(items, ["sequence_id", "offset"])],
        (F.col("_first") + F.floor(local / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (local % F.col("_each")) * F.col("_n")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, capacities: Capacities = Capacities()) -> DataFrame:
    """Pieces of all documents with their ids' crc32 and their place in a sequence (the query's columns)."""
    pieces = token_pieces(docs, vocabulary, pattern, end_id, capacities.tokens)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacities)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """Whole sequences as one binary of ids each: ``pieces`` with ids, ``placed`` as :func:`pack` returns them.

    A sequence is at most ``tokens`` long, so its group is bounded.
    """
    joined = pieces.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    together = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return together.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
