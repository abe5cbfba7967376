"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Validated values are permuted within the set of values of their format, so equal values get equal
pseudonyms in every document, different ones different ones, and a pseudonym passes the same validation:

* card numbers (13 to 19 digits, Luhn): all digits but the check digit, which is computed again;
* IBANs (mod 97): digits and letters after the check digits, each within its kind;
* telephone numbers: all digits after the country code, punctuation kept;
* US social security numbers (area, group and serial validated); IPv4 addresses;
* dates (ISO, and day/month/year or month/day/year with ``/`` or ``.``) from 1900 to 2099;
* e-mail addresses: letters and digits of the local part, each within its kind, case and marks kept.

The permutation of 0..size-1 is a Feistel network over pairs (left, right) of a square-like domain of at
least that size, walked again while the result lies beyond ``size``.  Local parts beyond ``CHUNK``
characters are permuted chunk by chunk, each under a digest of the chunks before it.  The key is the
caller's: whoever has it can undo the pseudonyms.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept_columns, quoted

ROUNDS, CHUNK = 10, 64
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "date")


class Feistel:
    """Keyed permutations of ranges of integers of at most 800 bits."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.sha256(key).digest()

    def __call__(self, value: int, size: int, tweak: str) -> int:
        if size < 2:
            return value
        left_size = math.isqrt(size - 1) + 1
        right_size = -(-size // left_size)
        while True:
            left, right = divmod(value, right_size)
            for k in range(ROUNDS):
                source, modulus = (right, left_size) if k % 2 == 0 else (left, right_size)
                message = f"{tweak}|{size}|{k}|{source}".encode()
                # 64 bits more than the modulus has, so that every remainder is about as likely.
                pad = int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=modulus.bit_length() // 8 + 9).digest(), "big")
                if k % 2 == 0:
                    left = (left + pad) % left_size
                else:
                    right = (right + pad) % right_size
            value = left * right_size + right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The digit that completes ``digits`` to a valid number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(p: Feistel, text: str) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    body = str(p(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}")).zfill(len(d) - 1)
    return _refill(text, body + luhn_digit(body))


def _phone(p: Feistel, text: str) -> str | None:
    country, rest = re.match(r"(\+\d{1,3}(?=\D)|\+\d)?(.*)", text, re.S).groups()
    d = _digits(rest)
    if not 7 <= len(d) <= 14:
        return None
    return (country or "") + _refill(rest, str(p(int(d), 10 ** len(d), f"phone{country}{len(d)}")).zfill(len(d)))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(p: Feistel, text: str) -> str | None:
    d = _digits(text)
    if not _ssn_valid(d):
        return None
    while True:
        d = str(p(int(d), 10**9, "ssn")).zfill(9)
        if _ssn_valid(d):
            return _refill(text, d)


def _ip(p: Feistel, text: str) -> str | None:
    try:
        value = int(ipaddress.IPv4Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(p(value, 1 << 32, "ip")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(p: Feistel, text: str) -> str | None:
    a, sign, b, c = re.match(r"(\d+)(\D)(\d+)\D(\d+)", text).groups()
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        part = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        new = datetime.date.fromordinal(_FIRST + p(day - _FIRST, _LAST - _FIRST + 1, "date"))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sign.join(values[k] for k in order)
    return None


def _mixed(p: Feistel, text: str, tweak: str) -> str:
    """Letters and digits permuted together, each within its kind; everything else and the case stay."""
    if len(text) > CHUNK:
        out, before = [], hashlib.blake2b(digest_size=16)
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            out.append(_mixed(p, part, f"{tweak}|{at}|{before.hexdigest()}|" if at else tweak))
            before.update(part.lower().encode("utf-8", "surrogatepass"))
        return "".join(out)
    value, size, radices = 0, 1, []
    for c in text:
        low = c.lower()
        radix = 10 if c in "0123456789" else 26 if "a" <= low <= "z" else 0
        radices.append(radix)
        if radix:
            value, size = value * radix + (ord(c) - 48 if radix == 10 else ord(low) - 97), size * radix
    shape = "".join({10: "0", 26: "a"}.get(r, c) for r, c in zip(radices, text, strict=True))
    value = p(value, size, f"{tweak}{shape}")
    out = []
    for c, radix in zip(reversed(text), reversed(radices), strict=True):
        if radix:
            value, digit = divmod(value, radix)
            n = chr(48 + digit) if radix == 10 else chr(97 + digit)
            c = n.upper() if c.isupper() else n
        out.append(c)
    return "".join(reversed(out))


def _email(p: Feistel, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_mixed(p, local, f'email{domain.lower()}')}@{domain}"


def _iban(p: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed(p, plain[4:], f"iban{plain[:2]}")
    new = f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}"
    chars = iter(new)
    return "".join(next(chars) if c != " " else c for c in text)


#: What may be a value of each kind, and what validates and permutes it; earlier kinds go first where two overlap.
_FIND: dict[str, tuple[re.Pattern, Callable[[Feistel, str], str | None]]] = {
    "email": (re.compile(r"[\w.%+-]++(?:@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})?"), _email),  # takes whole runs, so no run is scanned twice
    "ip": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _ip),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    "card": (re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"), _card),
    "ssn": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"), _phone),
    "date": (re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![\w/-]|\.\d))"), _date),
}
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w")


def _ibans(text: str, permute: Feistel) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of IBANs: what may be one is cut at word ends until mod 97 holds, longest first."""
    at = 0
    while m := _FIND["iban"][0].search(text, at):
        a, at = m.start(), m.start() + 1
        for b in range(m.end(), a + 14, -1):
            if text[b - 1] != " " and not _WORD.match(text, b) and (new := _iban(permute, text[a:b])) is not None:
                yield a, b, new
                at = b
                break


def find(text: str, permute: Feistel) -> list[tuple[int, int, str, str]]:
    """Validated values in order: start, end, kind, pseudonym.  They don't overlap.

    Time grows in proportion to the text: no pattern scans a run of characters again from each of them,
    and the values of a kind are merged with those found before, both in order.
    """
    kinds = ["email"] if "@" in text else []
    if _DIGIT.search(text):
        kinds += [k for k in KINDS if k != "email"]
    found: list[tuple[int, int, str, str]] = []
    for kind in kinds:
        pattern, make = _FIND[kind]
        if kind == "iban":
            spans = _ibans(text, permute)
        else:
            spans = ((*m.span(), None) for m in pattern.finditer(text) if kind != "email" or "@" in m[0])
        more, k = [], 0
        for a, b, new in spans:
            while k < len(found) and found[k][1] <= a:
                k += 1
            if k < len(found) and found[k][0] < b:
                continue
            new = new or make(permute, text[a:b])
            if new is not None:
                more.append((a, b, kind, new))
        found = sorted(found + more)
    return found


ADDED = "private_spans array<struct<start: int, end: int, kind: string>>, n_private long"


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymised, ``private_spans`` (of the old text) and ``n_private``.

    ``key`` must not be empty and is to be kept secret.  Spans count code points.  Null texts stay null with no span.  Columns of the input that clash with the
    added ones are replaced.
    """
    added = ["private_spans", "n_private"]
    rows = docs.select(*[quoted(c) for c in kept_columns(docs, added)])
    at = [c.lower() for c in rows.columns].index("text")
    permute = Feistel(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(at).to_pylist():
                found = find(text, permute) if text else []
                spans.append([{"start": a, "end": b, "kind": kind} for a, b, kind, _ in found])
                if found:
                    parts, last = [], 0
                    for a, b, _, new in found:
                        parts += [text[last:a], new]
                        last = b
                    text = "".join([*parts, text[last:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array([len(s) for s in spans], pa.int64())], names=[*batch.schema.names, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema), ADDED])
    return rows.mapInArrow(run, schema)
