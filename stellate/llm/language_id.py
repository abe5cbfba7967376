"""Language identification of mixed-language text.

The script of a word, told by code point ranges, leaves the languages that are written in it; the word's
character n-grams score these; Viterbi with a penalty for each switch of language then labels every word,
which gives spans.  The language of a text is the one with most letters in its spans.

The model learns n-gram counts from about ``sample`` labelled rows (documented bound, taken by a hash of
the id; rows that repeat an id come together, and only counts leave the tasks), and keeps the ``GRAMS``
most frequent n-grams of each language.  More than ``MOST_LANGUAGES`` languages are an error.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_map

GRAMS, MOST_LANGUAGES, SMOOTHING, SWITCH = 8000, 127, 0.5, 6.0
#: Words of which a worker remembers the scores.
MEMORY = 600_000
#: A script belongs to a language if at least this share of the language's letters is written in it.
LEAST_SHARE = 0.005
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of the ranges of each script.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script(c: str) -> str:
    """Script of a letter."""
    k = bisect_right(_STARTS, ord(c)) - 1
    return SCRIPTS[k][1] if k >= 0 else "other"


def words_of(text: str | None) -> list[str]:
    """Runs of letters (characters that ``isalpha``) in lower case."""
    out = []
    for w in _WORD.findall(text.lower()) if text else []:
        if w.isalpha():
            out.append(w)
        else:  # with numbers that are no digits, as in superscripts, fractions and Roman numerals
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams(word: str) -> list[str]:
    """Trigrams of a word with its edges."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def train_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: a language is known and crc32 of the id's text is not 2 modulo 4."""
    return docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def fit(rows: DataFrame, sample: int = 8000) -> dict:
    """Model of labelled rows (``doc_id, text, lang``); ``sample`` bounds how many are used.

    Null texts, languages and ids are left out.  Without rows the model knows no language.
    """
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    total = rows.select("doc_id").count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.where(share < min(1.0, sample / max(total, 1)))

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        words: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in words_of(text))
        found: Counter = Counter()
        for (lang, word), n in words.items():
            for g in grams(word):
                found[lang, "g" + g] += n
            found[lang, "s" + script(word[0])] += n * len(word)
        keys = list(found)
        yield {"lang": pa.array([k[0] for k in keys], pa.string()), "gram": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([found[k] for k in keys], pa.int64())}

    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = arrow_map(rows.select("text", "lang"), "lang string, gram string, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", F.substring("gram", 1, 1)).orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("k", F.row_number().over(by)).where(F.col("k") <= GRAMS).collect()  # GRAMS rows a language
    langs = sorted({r["lang"] for r in kept})
    number = {lang: k for k, lang in enumerate(langs)}
    totals, table, scripts = np.zeros(len(langs)), {}, {}
    for r in kept:
        k = number[r["lang"]]
        if r["gram"][0] == "g":
            totals[k] += r["n"]
            table.setdefault(r["gram"][1:], np.zeros(len(langs)))[k] = r["n"]
        else:
            scripts.setdefault(r["gram"][1:], np.zeros(len(langs)))[k] = r["n"]
    letters = sum(scripts.values()) if scripts else np.zeros(len(langs))
    scale = totals + SMOOTHING * max(len(table), 1)
    logs = {g: np.log((n + SMOOTHING) / scale).astype(np.float32) for g, n in table.items()}
    return {"id": uuid.uuid4().hex, "langs": langs, "grams": logs, "unseen": np.log(SMOOTHING / np.maximum(scale, 1)).astype(np.float32), "scripts": {s: n >= LEAST_SHARE * np.maximum(letters, 1) for s, n in scripts.items()}}


class Scorer:
    """Scores of words for each language, remembered up to a bound."""

    def __init__(self, model: dict):
        self.model, self.k = model, len(model["langs"])
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, self.k), np.float32)
        self.told = np.zeros(1024, bool)  # whether a language is written in the word's script
        self.held = 0  # characters of the words

    def _score(self, word: str) -> np.ndarray | None:
        allowed = self.model["scripts"].get(script(word[0]))
        if allowed is None or not allowed.any():
            return None  # no candidate: the word says nothing
        known, unseen = self.model["grams"], self.model["unseen"]
        s = sum((known.get(g, unseen) for g in grams(word)), np.zeros(self.k, np.float32))
        s = s - s.max()
        return np.where(allowed, np.maximum(s, -30.0), -60.0).astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        for w in {*words}.difference(number):
            n = number[w] = len(number)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.told = np.concatenate([self.told, np.zeros_like(self.told)])
            found = self._score(w)
            self.held += len(w)
            if found is not None:
                self.table[n], self.told[n] = found, True
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def rest(self) -> None:
        """Called between blocks: forgets if too much is remembered."""
        if len(self.number) > MEMORY or self.held > 16 * MEMORY:
            self._clear()


_kept: dict[str, Scorer] = {}


def _scorer(model: dict) -> Scorer:
    """The model's scorer in this worker process, with what it remembers; one model at a time is kept."""
    if model["id"] not in _kept:
        _kept.clear()
        _kept[model["id"]] = Scorer(model)
    return _kept[model["id"]]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: sum of scores less ``penalty`` for each switch; ties go to the smaller label.

    ``scores`` holds the words of texts in a row, ``lengths`` how many each text has.  All texts advance
    one word at a time together.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int8)
    if not n:
        return out
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    start, size = start[order], lengths[order]
    running = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts with more than t words
    stay = np.zeros((n, k), bool)
    best = np.zeros(n, np.int8)
    value = scores[start[: running[0]]].astype(np.float64) if running[0] else np.zeros((0, k))
    last = np.zeros(len(size), np.int64)
    for t in range(1, int(size[0])):
        a = running[t]
        if a < len(value):
            last[a : len(value)] = value[a:].argmax(axis=1)
            value = value[:a]
        at = start[:a] + t
        top = value.argmax(axis=1)
        switch = value[np.arange(a), top] - penalty
        keep = value >= switch[:, None]
        stay[at], best[at] = keep, top
        value = np.where(keep, value, switch[:, None]) + scores[at]
    last[: len(value)] = value.argmax(axis=1)
    label = last
    for t in range(int(size[0]) - 1, -1, -1):
        a = running[t]
        at = start[:a] + t
        out[at] = label[:a]
        if t:
            label[:a] = np.where(stay[at, label[:a]], label[:a], best[at])
    return out


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: int, words: int, lang: string>>"


def predict(docs: DataFrame, model: dict, penalty: float = SWITCH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` for every row.

    ``score`` is the share of letters that are in spans of the predicted language and in a word whose script
    some language is written in; ties go to the first language in alphabetical order, as does, with score
    0, a text in scripts that no language is written in.  A null text, or one without a letter, is ``und``
    with score 0 and no span, as is every text for a model without languages.  A span counts words from 0.
    Only the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = _scorer(model), model["langs"]
        names = [x.split()[0] for x in PREDICTED.split(", ", 4)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                lists = [words_of(t) if langs else [] for t in some.column(1).to_pylist()]
                lengths = np.array([len(w) for w in lists], np.int64)
                ids = [scorer.ids(w) for w in lists]
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                labels = viterbi(scorer.table[flat], lengths, penalty) if langs else np.zeros(0, np.int8)
                letters = np.fromiter((len(w) for ws in lists for w in ws), np.int64, len(flat))
                owner = np.repeat(np.arange(len(lists)), lengths)
                mass = np.bincount(owner * max(len(langs), 1) + labels, weights=letters, minlength=len(lists) * max(len(langs), 1)).reshape(len(lists), -1)
                top, total = mass.argmax(axis=1), mass.sum(axis=1)
                edge = np.ones(len(flat), bool)
                edge[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(edge)
                ends = np.append(first[1:], len(flat))[: len(first)]
                begin = np.concatenate([[0], np.cumsum(lengths)])
                spans: list[list[dict]] = [[] for _ in lists]
                for f, e in zip(first.tolist(), ends.tolist(), strict=True):
                    o = owner[f]
                    spans[o].append({"start": int(f - begin[o]), "words": e - f, "lang": langs[labels[f]]})
                pred = [langs[top[i]] if total[i] else "und" for i in range(len(lists))]
                sure = np.bincount(owner, weights=letters * (scorer.told[flat] & (labels == top[owner])), minlength=len(lists)) if langs else total
                share = sure / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(pred, pa.string()), pa.array(share), pa.array(spans, kind)], names=names)
                scorer.rest()

    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held_out")).mapInArrow(run, PREDICTED)
