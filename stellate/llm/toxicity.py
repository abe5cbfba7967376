"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades run from 0 to ``GRADES - 1``.  P(grade <= k) = logistic(threshold_k - w.x) with one weight vector
for all of the ordered thresholds; the expected severity is the sum over k of P(grade > k).

Features are the distinct words of a text in lower case and their prefixes of 5 to 8 bytes, of which
those are kept that tell toxic from other rows (log-likelihood ratio over the sample).  Labels say only
whether a row is toxic, so toxic rows of the sample get grades 1 and up by quantiles of their lexical
evidence (sum of root ratios) as the *other* half of the sample tells it: no row is graded by statistics
that it is part of, nor by the weights that are fitted.  The fit takes at most
``toxic_sample`` toxic and ``clean_sample`` other labelled documents, in one task of that bounded size;
scoring runs over Arrow batches of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, arrow_map, kept_columns, mix, powers, quoted, spans_where, text_blocks
from .quality import sampled_ids, sampled_texts

GRADES = 4
PREFIXES = (5, 6, 7, 8)
LEAST_RATIO, MOST_TERMS = 25.0, 4000
#: Fixed threshold: a text is toxic if P(grade >= 1) reaches it.
LEAST_PROBABILITY = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1's two-byte letters, in place of length."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a block of texts (words and prefixes, repeated ones too) and their text numbers."""
    data = _lower(data)
    starts, ends, owner = spans_where(_LETTER[data], offsets)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), dtype=U64, out=total[1:])
    scale = powers(len(data) + 1, inverse=True)[starts] if len(starts) else np.zeros(0, U64)
    hashes, owners = [mix((total[ends] - total[starts]) * scale)], [owner]
    for n in PREFIXES:
        longer = ends - starts > n
        s = starts[longer]
        hashes.append(mix((total[s + n] - total[s]) * scale[longer] + U64(n)))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l2: float = 1e-5, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link (logit) model, by Adam on the mean log-likelihood."""
    n, width = x.shape
    w = np.zeros(width)
    share = np.array([max((grade <= k).mean(), 1e-3) for k in range(grades - 1)])
    cut = np.log(share / np.maximum(1 - share, 1e-3))
    # The first threshold, then logarithms of the gaps: keeps them ordered.
    base, gaps = cut[0], np.log(np.maximum(np.diff(cut), 0.1))
    parts = [w, np.array([base]), gaps]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        w, base, gaps = parts[0], parts[1][0], parts[2]
        cut = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = x @ w
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        upper, lower = sigmoid(edge[grade + 1] - z), sigmoid(edge[grade] - z)
        upper[grade == grades - 1], lower[grade == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_z = (d_upper - d_lower) / n  # derivative of the mean negative log-likelihood by z
        g_cut = np.array([(-d_upper[grade == k].sum() + d_lower[grade == k + 1].sum()) / n for k in range(grades - 1)])
        gradient = [x.T @ g_z + l2 * w, np.array([g_cut.sum()]), np.array([g_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 2)])]
        for k, g in enumerate(gradient):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            parts[k] = parts[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return parts[0], parts[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(parts[2]))])


def _telling(index: np.ndarray, where: np.ndarray, toxic: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` terms tell toxic from other rows among the ``chosen`` rows, and their log-likelihood ratios.

    ``index`` and ``where`` are the distinct terms of each row and the row's number.
    """
    at = chosen[where]
    up = np.bincount(index[at], weights=toxic[where[at]], minlength=n)
    down = np.bincount(index[at], minlength=n) - up
    n_up, n_down = max(float((toxic & chosen).sum()), 1.0), max(float((~toxic & chosen).sum()), 1.0)
    rate = (up + down) / (n_up + n_down)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(up > 0, up * np.log(up / (n_up * rate)), 0) + np.where(down > 0, down * np.log(down / (n_down * rate)), 0))
    return (up / n_up > 3 * down / n_down) & (ratio >= LEAST_RATIO), ratio


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Model of the sample's rows (``id_hash, label, terms``)."""
    rows = rows.sort_values("id_hash")
    toxic = rows["label"].to_numpy() == 1
    none = pd.DataFrame({"terms": [], "weights": [], "thresholds": []})
    if toxic.all() or not toxic.any():
        return none
    lists = [np.frombuffer(t, U64) for t in rows["terms"]]
    where = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    known, index = np.unique(np.concatenate(lists), return_inverse=True)
    tells, ratio = _telling(index, where, toxic, np.ones(len(lists), bool), len(known))
    telling = np.flatnonzero(tells)
    telling = np.sort(telling[np.argsort(-ratio[telling], kind="stable")][:MOST_TERMS])
    if not len(telling):
        return none
    position = np.full(len(known), -1)
    position[telling] = np.arange(len(telling))
    at = position[index]
    x = np.zeros((len(lists), len(telling)))  # at most the samples' rows by MOST_TERMS; float64, as products with float32 convert it at every step
    x[where[at >= 0], at[at >= 0]] = 1
    # Evidence of each half of the rows, by what the other half tells.
    half = np.arange(len(lists)) % 2 == 0
    evidence = np.zeros(len(lists))
    for own in (half, ~half):
        tells, ratio = _telling(index, where, toxic, ~own, len(known))
        evidence[own] = np.bincount(where, weights=(np.sqrt(np.maximum(ratio, 0)) * tells)[index], minlength=len(lists))[own]
    grade = np.where(toxic, 1, 0)
    for q in range(1, GRADES - 1):
        grade[toxic & (evidence > np.quantile(evidence[toxic], q / (GRADES - 1)))] += 1
    # Grades that ties leave empty go.
    present, grade = np.unique(grade, return_inverse=True)
    w, cut = fit_ordinal(x, grade, len(present))
    return pd.DataFrame({"terms": [known[telling].tobytes()], "weights": [w.astype(float).tobytes()], "thresholds": [cut.astype(float).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int = 1500, clean_sample: int = 2500) -> dict | None:
    """The model of labelled rows, or None if one of the classes has no row or no term tells them apart.

    The samples bound the documents that are fitted, those whose id hashes lowest.  Null texts, labels and
    ids are left out; a document with several label rows counts once, as toxic if one says so; of rows that
    share an id the one with the least text counts.
    """
    whole = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled_ids(whole.where("toxic = 1"), "toxic", toxic_sample, 3).union(sampled_ids(whole.where("toxic <> 1"), "toxic", clean_sample, 3))
    sample = sampled_texts(docs, chosen)

    def features(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            h, owner = terms(data, offsets)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(last - first + 1))
            lists = [np.unique(h[order[cuts[k] : cuts[k + 1]]]).tobytes() for k in range(last - first)]
            yield {"id_hash": batch.column(0)[first:last], "label": batch.column(2)[first:last], "terms": pa.array(lists, pa.binary())}

    made = arrow_map(sample, "id_hash long, label int, terms binary", features)
    model = made.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(_train, "terms binary, weights binary, thresholds binary").collect()
    return {k: bytes(model[0][k]) for k in ("terms", "weights", "thresholds")} if model else None


ADDED = "severity double, toxic_probability double, grade int, toxic boolean"


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` with ``severity`` (expected), ``toxic_probability``, ``grade`` and ``toxic``.

    ``grade`` is the most probable one.  Null and empty texts have severity near 0.  Without a model
    nothing is toxic.  Columns of the input that clash with the added ones are replaced.
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    rows = docs.select(*[quoted(c) for c in kept_columns(docs, added)])
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(model["terms"], U64) if model else np.zeros(0, U64)
        weights = np.frombuffer(model["weights"]) if model else np.zeros(0)
        cut = np.frombuffer(model["thresholds"]) if model else np.array([50.0])
        maybe = np.zeros(1 << 16, bool)
        maybe[(known >> U64(48)).astype(np.int64)] = True
        for batch in batches:
            z = []
            for _, _, data, offsets in text_blocks(batch.column(at)):
                h, owner = terms(data, offsets)
                near = maybe[(h >> U64(48)).astype(np.int64)]
                h, owner = h[near], owner[near]
                index = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[index] == h if len(known) else np.zeros(len(h), bool)
                pairs = np.unique(owner[hit] * max(len(known), 1) + index[hit])
                z.append(np.bincount(pairs // max(len(known), 1), weights=weights[pairs % max(len(known), 1)], minlength=len(offsets) - 1) if len(known) else np.zeros(len(offsets) - 1))
            if not z:
                continue
            over = 1 / (1 + np.exp(np.clip(cut[None, :] - np.concatenate(z)[:, None], -50, 50)))  # P(grade > k)
            each = np.concatenate([np.ones((len(over), 1)), over], axis=1) - np.concatenate([over, np.zeros((len(over), 1))], axis=1)
            columns = [pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= LEAST_PROBABILITY)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema), ADDED])
    return rows.mapInArrow(run, schema)
