"""Shared helpers of the training-data operators: shared folders, Arrow maps and NumPy text kernels.

Nothing here is corpus specific.  The kernels work on blocks of an Arrow batch, so what a Python
worker holds is bounded by a block (about a megabyte of text) or by one document, never by a partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U64 = np.uint64
_GAMMA = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session.  Where it is unset a local master, as in tests, gets a temporary
    folder, set as the checkpoint directory; any other one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than 1 / HOT of all rows is hot; there are fewer than HOT of these, however large the data.
HOT = 1024


def joined(rows: DataFrame, table: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``: one row for each ``on``, and ``n``, how many of ``rows`` have it.

    ``total`` is the number of ``rows``.  Hot keys are fewer than ``HOT``, so their part of the table is
    broadcast and their rows stay where they are; the shuffled join of the others has no larger group.
    ``n`` is left out.  A row with a null key joins nothing.  ``table`` must be cheap to read (a written one).
    """
    is_hot = F.col("n") > total / HOT
    if table.where(is_hot).isEmpty():
        return rows.join(table.drop("n"), on, how)
    hot = F.broadcast(table.where(is_hot).drop("n"))
    names = F.broadcast(table.where(is_hot).select(F.col(on)))
    cold = rows.join(names, on, "left_anti").join(table.where(~is_hot).drop("n"), on, how)
    return rows.join(hot, on).unionByName(cold)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_columns(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` that do not clash (case-insensitively) with the names an operator adds."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def quoted(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterable[dict]]) -> DataFrame:
    """``mapInArrow`` for functions that turn one record batch into column dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- NumPy text kernels
def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element by element."""
    x = x + _GAMMA
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the polynomial base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), U64(_INVERSE if inverse else _BASE))
        step[0] = 1
        have = np.cumprod(step, dtype=U64)
        if n <= 1 << 22:
            _powers[key] = have
    return have[:n]


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string array into runs of whole texts of about ``max_bytes``: (first, last, bytes, offsets)."""
    data, offsets = text_arrays(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def spans_where(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes that do not cross texts: starts, ends, text number."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, i.e. runs of anything but space, \\t, \\n, \\v, \\f and \\r: starts, ends, text number."""
    return spans_where(~_SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(n), dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts] + mix((ends - starts).astype(U64)))


def window_hashes(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within one text: hash, text number, index of the first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    h = np.zeros(len(first), U64)
    for k in range(size):
        h = mix(h ^ words[first + k])
    return h, owner[first], first
