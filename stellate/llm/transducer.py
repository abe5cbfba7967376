"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a byte string can be read left to right: the encoding of each prefix ends in exactly one
token whose pair with the token before it is stable under the merges, where a pair is stable if BPE of its
joined bytes gives the pair back.  A *configuration* is a place where a token may still begin: the trie
node of the bytes since then, the token that ends there, and the tokens on the way there that are not
emitted yet.  A *state* is the set of configurations that bytes to come can still reach; what all of them
share is emitted.  A configuration dies when no token goes on, so output lags by one token's length at
most.  States and steps are made when first met and kept up to a bound, which a single long piece meets too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map
from .tokens import _Memory, loaded


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``tiktoken`` file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: merge the pair of lowest rank, the leftmost among equals, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes pieces; ``limit`` bounds the states that are kept."""

    _FINAL, _CONFIGURATIONS = -1, -2

    def __init__(self, ranks: dict[bytes, int], limit: int = 350_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for data, i in ranks.items():
            node = 0
            for b in data:
                step = self.children[node].get(b)
                if step is None:
                    step = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = step
            self.token[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.packed = {i: struct.pack("<I", i) for i in self.bytes_of}
        self._clear()

    def _clear(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # steps form cycles
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((0, -1, b""),))

    def _state(self, configurations: tuple) -> dict:
        state = self.states.get(configurations)
        if state is None:
            state = self.states[configurations] = {self._CONFIGURATIONS: configurations}
            state[self._FINAL] = configurations[-1][2]  # of the place where the last token ended
        return state

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; (token, -1) for a byte, None if BPE never gives it."""
        if token not in self.halves:
            data = self.bytes_of[token]
            if len(data) == 1:
                found = (token, -1)
            else:
                two = merged(data, {b: r for b, r in ((data[i:j], self.ranks.get(data[i:j])) for i in range(len(data)) for j in range(i + 1, len(data) + 1)) if r is not None and b != data})
                found = (two[0], two[1]) if len(two) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def _is_stable(self, first: int, second: int) -> bool:
        """Whether BPE of the joined bytes of two tokens gives the two tokens.

        Merges run by rising rank, equal ones from the left.  So time is run backwards: the later of the
        two merges at the seam is undone, and at each moment a merge over the seam must not come first.
        """
        if self._halves(first) is None or self._halves(second) is None:
            return False
        if len(self.stable) > 600_000:
            self.stable.clear()
        x, y, x_ends, y_ends = first, second, 1 << 60, 1 << 60
        while True:
            over = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if over is not None and over < x_ends and over <= y_ends:
                known = False
                break
            hx, hy = self._halves(x), self._halves(y)
            if hx[1] < 0 and hy[1] < 0:
                known = True
                break
            if hy[1] < 0 or (hx[1] >= 0 and x > y):
                x, x_ends = hx[1], x
            else:
                y, y_ends = hy[0], y
        self.stable[first, second] = known
        return known

    def _step(self, state: dict, byte: int) -> tuple[bytes, dict]:
        children, token, stable = self.children, self.token, self.stable
        alive, ended = [], None
        for node, last, pending in state[self._CONFIGURATIONS]:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                alive.append((node, last, pending))
            t = token[node]
            if t >= 0 and ended is None:
                fits = self._halves(t) is not None if last < 0 else stable.get((last, t))
                if fits is None:
                    fits = self._is_stable(last, t)
                if fits:
                    ended = (0, t, pending + self.packed[t])
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append(ended)
        shared, least = 0, ended[2]
        if len(alive) == 1:
            shared = len(least)
        else:
            outputs = [c[2] for c in alive]
            least, most = min(outputs), max(outputs)
            while shared + 4 <= len(least) and least[shared : shared + 4] == most[shared : shared + 4]:
                shared += 4
        if shared:
            alive = [(node, last, pending[shared:]) for node, last, pending in alive]
        step = state[byte] = (least[:shared], self._state(tuple(alive)))
        return step

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit bytes."""
        if not piece:
            return b""
        out, state, step = bytearray(), self.start, self._step
        for at in range(0, len(piece), 4096):
            if len(self.states) > self.limit:
                here = state[self._CONFIGURATIONS]
                self._clear()
                state = self._state(here)
            for b in piece[at : at + 4096]:
                emitted, state = state.get(b) or step(state, b)
                if emitted:
                    out += emitted
        return bytes(out + state[self._FINAL])


#: Unicode white space.  A text can be cut where white space follows something else: no match spans such a place.
_WHITE = "\t-\r \x85\xa0  -     　"


class Encoder:
    """Cuts texts into pieces by ``pattern`` and encodes each piece; remembers chunks met before, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 500_000):
        self.transducer = Transducer(ranks)
        cut = regex.compile(pattern).findall
        encode = self.transducer.encode
        self.chunks = _Memory(lambda chunk: b"".join([encode(p.encode()) for p in cut(chunk)]), memory)
        self.split = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.split(text))) if text else b""


class Utf8Machine:
    """Incremental UTF-8 decoding of bytes that may be cut anywhere.

    States: 0 between characters, 1 to 3 so many continuation bytes are missing, 4 to 7 after E0, ED, F0
    and F4, whose next byte has a narrower range, 8 malformed.  ``feed`` returns the text that is complete
    and holds back an unfinished character, three bytes at most; malformed bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def step(state: int, b: int) -> int:
        if state == 0:
            if b < 0x80:
                return 0
            if 0xC2 <= b <= 0xDF:
                return 1
            if 0xE0 <= b <= 0xEF:
                return {0xE0: 4, 0xED: 5}.get(b, 2)
            if 0xF0 <= b <= 0xF4:
                return {0xF0: 6, 0xF4: 7}.get(b, 3)
            return 8
        low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, 8))
        return then if low <= b <= high else 8

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:  # the last byte that can begin a longer character
                state = 0
                for b in data[-back:]:
                    state = self.step(state, b)
                    if state in (0, 8):
                        break
                if state not in (0, 8):
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids back to bytes and text, a block of ids at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.bytes_of[i] = data

    def blocks(self, ids: np.ndarray, block: int = 65536) -> Iterator[bytes]:
        for at in range(0, len(ids), block):
            yield b"".join(map(self.bytes_of.__getitem__, ids[at : at + block].tolist()))

    def stream(self, blocks: Iterable[bytes]) -> Iterator[str]:
        machine = Utf8Machine()
        for data in blocks:
            yield machine.feed(data)
        yield machine.finish()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: token ids of whole texts as little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids; null ids and repeated rows are kept; other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = loaded(f"transducer {ranks_path}", lambda: Encoder(read_ranks(ranks_path), pattern))
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            yield {"doc_id": some.column(0), "ids": pa.array([encoder(t) for t in some.column(1).to_pylist()], pa.binary())}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, ids binary", run)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text``: streaming decode of :func:`encode`'s ids; a null ``ids`` gives a null text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        decoder = loaded(f"decoder {ranks_path}", lambda: Decoder(read_ranks(ranks_path)))
        texts = [None if x is None else "".join(decoder.stream(decoder.blocks(np.frombuffer(x, "<u4")))) for x in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "text": pa.array(texts, pa.string())}

    return arrow_map(encoded.select("doc_id", "ids"), "doc_id long, text string", run)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again, and return the digests of both.

    Rows: ``doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars`` (code points of the decoded text).
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = loaded(f"transducer {ranks_path}", lambda: Encoder(read_ranks(ranks_path), pattern))
        decoder = loaded(f"decoder {ranks_path}", lambda: Decoder(encoder.transducer.ranks))
        for at in range(0, batch.num_rows, 1000):
            some, rows = batch.slice(at, 1000), []
            for text in some.column(1).to_pylist():
                data = encoder(text)
                digest, machine, chars = hashlib.sha256(), Utf8Machine(), 0
                for block in decoder.blocks(np.frombuffer(data, "<u4")):
                    digest.update(block)
                    chars += len(machine.feed(block))
                rows.append((len(data) // 4, hashlib.sha256(data).hexdigest(), digest.hexdigest(), chars + len(machine.finish())))
            n, ids, decoded, chars = zip(*rows, strict=True)
            yield {"doc_id": some.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded), "decoded_chars": pa.array(chars, pa.int64())}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long", run)
