"""Token ids of the public vocabularies as little-endian unsigned 32-bit bytes.

Ids are those of the ``tokenizers`` library with ``add_special_tokens=False``; a special token's string in
a text has that token's id, as the library has it.  ``ByteLevelIds`` runs the vocabulary of a byte-level
file on the ``tiktoken`` engine, which gives the same ids several times faster (the tests hold both
libraries against each other); texts with ``<|``, where a special token may stand, or with a run of
``LONGEST_RUN`` spaces or other characters, which overflows that engine's stack, go to the library.
``WordIds`` runs the library and remembers words that it has met: BPE never looks across a cut between
words, so the ids of a text are the ids of its words in a row.  That memory is bounded in entries and
in bytes: it is emptied when it is full, and long keys aren't kept.
"""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Callable
from functools import cached_property

#: Most words that a worker remembers, and the longest one in characters.
MEMORY, LONGEST_KEY = 900_000, 64
#: A longer run of white space, or of anything else, is the library's.
LONGEST_RUN = 4000
_loaded: dict[str, object] = {}


def loaded(key: str, make: Callable[[], object]) -> object:
    """One object per worker process and key, made on first use."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def tokenizer(path: str):
    """The library's tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(library, text: str) -> bytes:
    return array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def most_id(path: str) -> int:
    """The largest id of a vocabulary, special tokens among them."""
    return max(tokenizer(path).get_vocab(with_added_tokens=True).values())


def shown_bytes() -> list[str]:
    """The printable character that byte-level BPE writes for each byte, by its public rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class ByteLevelIds:
    """Ids of a byte-level BPE vocabulary given as ``tokenizers`` JSON; null and empty texts have none."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        byte_of = {c: b for b, c in enumerate(shown_bytes())}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.engine = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.long = re.compile(rf"\s{{{LONGEST_RUN}}}|\S{{{LONGEST_RUN}}}").search

    @cached_property
    def whole(self):
        """The library, made when a text first needs it."""
        return tokenizer(self.path)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or (len(text) >= LONGEST_RUN and self.long(text)):
            return library_ids(self.whole, text)
        return array.array("I", self.engine.encode_ordinary(text)).tobytes()


class _Memory(dict):
    """dict of bounded size that computes what it misses; keys beyond ``LONGEST_KEY`` are not kept."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


#: White space, and Latin-1 letters and numbers, as the word vocabulary's cutting pattern sees them.
_WHITE = "\t-\r \x85\xa0"
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"


class WordIds:
    """Ids of the lower-case word BPE (``tokenizers`` JSON); null and empty texts have none.

    Texts of Latin-1 characters without ``<|`` are lower-cased and cut here and each of their words goes to
    the library's BPE once; any other text goes to the library as a whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.whole = tokenizer(path)
        tokenize = self.whole.model.tokenize
        table = dict(enumerate(shown_bytes()))

        def word(piece: str) -> bytes:
            if not (piece.isascii() and piece.isprintable()):
                piece = piece.encode().decode("latin-1").translate(table)
            return array.array("I", [t.id for t in tokenize(piece)]).tobytes()

        self.words = _Memory(word, memory)
        self.cut = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_WHITE}{_LETTER}{_NUMBER}]+").findall

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return library_ids(self.whole, text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return library_ids(self.whole, text)
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))
