"""Quality rules: counted base rules, and hashed n-gram logistic regression with calibrated probabilities.

Fitting takes labelled rows: all of them up to ``sample`` (documented bound), beyond it those whose id
hashes lowest.  Sparse features of the sample, in 2**BITS buckets for words, pairs of words and character
trigrams each, are made and fitted in one task of bounded size: at most ``sample`` documents, one row each,
whose texts take less room than their features, which lie in a temporary file.  A fifth of it, by id hash, is kept out of the fit and calibrates the probability (Platt).
Scoring runs over Arrow batches of whole texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept_columns, quoted, span_hashes, text_blocks, window_hashes, word_spans
from .text_features import linear_scores, sparse_features

BITS = 18
#: Bytes of the texts whose features are made at once: these take about a hundred times as much.
BLOCK_BYTES = 1 << 18
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 50, 50, 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _second_on(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same text."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        o, x = owner[order], h[order]
        same[order[1:]] = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    return same


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of whole texts, by the words between white space (space, \\t to \\r).

    ``word_chars`` code points in words, ``n_symbols`` characters of ``#*$%&|<>``, ``n_dup_lines`` lines
    with a word that equal an earlier line, ``n_repeat_words`` words in three-word windows that the text
    has at least twice (the first one included).
    """
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # Lines: cut at \n and at the ends of texts.
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_start, line_end = edges[:-1], edges[1:]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.where(data[line_end - 1] == 10, line_end - 1, line_end) if len(line_end) else line_end
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_owner = line_start[has_word], line_end[has_word], line_owner[has_word]
    twice = _second_on(line_owner, span_hashes(data, line_start, line_end))
    # Words under windows that occur twice or more.
    words = span_hashes(data, starts, ends)
    windows, window_owner, first = window_hashes(words, owner, 3)
    again = np.zeros(len(windows), bool)
    if len(windows):
        order = np.lexsort((windows, window_owner))
        o, x = window_owner[order], windows[order]
        equal = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[first[again] + k] = True
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": np.bincount(owner, weights=points[ends] - points[starts], minlength=n).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_owner[twice], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
    }


def sampled_ids(labels: DataFrame, label: str, sample: int, salt: int) -> DataFrame:
    """``_id, label`` of at most ``sample`` labelled documents, those whose id hashes lowest.

    Null ids and labels are left out; a document with several label rows has the greatest one.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("_id", F.lit(salt)), "_id").limit(sample)


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``id_hash, text, label`` of the chosen documents; of rows that share an id the one with the least text counts."""
    # What is chosen is at most a sample of two numbers a row, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where("text is not null")
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return rows.select(F.xxhash64("_id", F.lit(11)).alias("id_hash"), "text", "label")


def filed(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows as views of a temporary file, whose pages the system may drop from memory; it goes with the last view."""
    cuts = [0]
    with tempfile.TemporaryFile() as file:
        for at, x in rows:
            file.write(at.astype(np.int32).tobytes())
            file.write(x.astype(np.float32).tobytes())
            cuts.append(cuts[-1] + len(at))
        file.flush()
        raw = np.memmap(file, np.int32, "r") if cuts[-1] else np.zeros(0, np.int32)
    raw = np.asarray(raw)
    return [(raw[2 * a : a + b], raw[a + b : 2 * b].view(np.float32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, epochs: int = 12, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by AdaGrad over sparse rows (buckets and shares); classes weigh the same.

    Rows come in a new, seeded order in each epoch.
    """
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, seen = np.zeros(width), np.full(width, 1e-8)
    b, b_seen = 0.0, 1e-8
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            z = float(w[at] @ x) + b
            g = weight[i] * (1 / (1 + np.exp(-min(max(z, -50.0), 50.0))) - y[i])
            step = g * x
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            b_seen += g * g
            b -= rate * g / b_seen**0.5
    return w, b


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Newton's method, smoothed targets)."""
    up, down = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([score, np.ones_like(score)], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        g = x.T @ (p - target) + 1e-3 * (a - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        a = a - np.clip(move, -5, 5)
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> dict | None:
    """The quality model of labelled rows, or None if there is no labelled row of each class.

    ``sample`` bounds how many labelled documents are fitted.
    """
    rows = sampled_texts(docs, sampled_ids(labels, "quality", sample, 7))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id_hash")
        y = rows["label"].to_numpy(float)
        held = (rows["id_hash"].to_numpy() % 5) == 0
        if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
            held[:] = False
        if len({*y}) < 2:
            return pd.DataFrame({"at": [], "weights": [], "intercept": []})
        texts = pa.array(rows.pop("text"), pa.large_string())
        sparse = filed(part for _, _, data, offsets in text_blocks(texts, BLOCK_BYTES) for part in sparse_features(data, offsets, BITS))
        del texts
        fitted = np.flatnonzero(~held)
        w, b = fit_logistic([sparse[k] for k in fitted], y[fitted], 3 << BITS)
        tested = np.flatnonzero(held) if held.any() else fitted
        score = np.array([w[sparse[k][0]] @ sparse[k][1] for k in tested]) + b
        slope, intercept = platt(score, y[tested])
        at = np.flatnonzero(w).astype(np.int32)
        return pd.DataFrame({"at": [at.tobytes()], "weights": [(w[at] * slope).astype(np.float32).tobytes()], "intercept": [b * slope + intercept]})

    model = rows.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(train, "at binary, weights binary, intercept double").collect()
    return {"at": bytes(model[0]["at"]), "weights": bytes(model[0]["weights"]), "intercept": model[0]["intercept"]} if model else None


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_probability double, kept boolean"


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` with the base counts, ``base_failed``, ``quality_probability`` and ``kept``.

    Null texts have no word, so they fail the base rules.  Without a model the base rules decide.  Columns
    of the input that clash with the added ones are replaced.
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    rows = docs.select(*[quoted(c) for c in kept_columns(docs, added)])
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            weights = np.zeros(3 << BITS, np.float32)
            weights[np.frombuffer(model["at"], np.int32)] = np.frombuffer(model["weights"], np.float32)
        for batch in batches:
            parts = []
            for _, _, data, offsets in text_blocks(batch.column(at), BLOCK_BYTES):
                found = base_counts(data, offsets)
                found["base_failed"] = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
                z = linear_scores(data, offsets, weights, BITS) + model["intercept"] if model else np.full(len(offsets) - 1, 50.0)
                found["quality_probability"] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                found["kept"] = ~found["base_failed"] & (found["quality_probability"] >= LEAST_PROBABILITY)
                parts.append(found)
            if parts:
                columns = [pa.array(np.concatenate([p[c] for p in parts])) for c in added]
                columns = [c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema), ADDED])
    return rows.mapInArrow(run, schema)
