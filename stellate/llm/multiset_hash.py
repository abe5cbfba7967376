"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

A text is a multiset of *paragraphs*: its lines with their ends, long ones cut every ``WORDS`` words.
Each paragraph hashes to a wide vector, and the fingerprint is the sum of the vectors modulo powers of two:

* ``WIDE`` components modulo 2**64, for equality;
* 2 * 32 * ``PACKS`` components modulo 2**32, each 0 or 1 for one paragraph, two to a 64-bit word.

So the order of paragraphs doesn't count, the fingerprint of two texts joined is the sum of theirs, and a
paragraph is inserted or deleted by adding or subtracting its vector (:func:`inserted`, :func:`deleted`).
A component counts at most one for each paragraph, so at most one for each of a string's fewer than 2**31
bytes: no sum of one text carries into its neighbour or leaves a long.  Components of 0 and 1 are centred to
-1 and 1 for :func:`likeness`: their products estimate the inner product of the multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions

WORDS = 8
WIDE = 4
PACKS = 2
_SEGMENT = rf"(?:[^\S\n]*+\S++){{1,{WORDS}}}+(?:[^\S\n]*+\n)?+|[^\S\n]*+\n|[^\S\n]++"
_LANES = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text, which joined give the text; an empty text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SEGMENT), F.lit(0))


def paragraph_vector(paragraph: Column) -> Column:
    """Vector of one paragraph as an array of long."""
    wide = [F.xxhash64(paragraph, F.lit(k)) for k in range(WIDE)]
    lanes = [F.shiftrightunsigned(F.xxhash64(paragraph, F.lit(100 + p)), k).bitwiseAND(F.lit(_LANES)) for p in range(PACKS) for k in range(32)]
    return F.array(F.lit(1).cast("long"), *wide, *lanes)



def added(a: Column, b: Column) -> Column:
    """Sum of two vectors modulo 2**64 in every word."""
    return F.zip_with(a, b, _wrapping_add)


def _wrapping_add(x: Column, y: Column) -> Column:
    """x + y modulo 2**64 also where ANSI mode would raise: add the halves apart."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)) + y.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as an array of long: the count of paragraphs, then the words of its vector.

    Null counts as empty; the empty text has the zero vector.  Equal texts have equal fingerprints.
    """
    segments = paragraphs(text)
    per = F.transform(segments, lambda s: F.struct(*[F.xxhash64(s, F.lit(k)).alias(f"w{k}") for k in range(WIDE)], *[F.xxhash64(s, F.lit(100 + p)).alias(f"p{p}") for p in range(PACKS)]))
    zero = F.lit(0).cast("long")
    # One pass over the paragraphs: the words modulo 2**64 as two halves each, the packed words as they are.
    names = ["n", *[f"{h}{k}" for k in range(WIDE) for h in "lh"], *[f"s{p}_{k}" for p in range(PACKS) for k in range(32)]]
    start = F.struct(*[zero.alias(x) for x in names])

    def step(a: Column, s: Column) -> Column:
        out = [(a["n"] + 1).alias("n")]
        for k in range(WIDE):
            out.append((a[f"l{k}"] + s[f"w{k}"].bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"l{k}"))
            out.append((a[f"h{k}"] + F.shiftrightunsigned(s[f"w{k}"], 32)).alias(f"h{k}"))
        for p in range(PACKS):
            for k in range(32):
                out.append((a[f"s{p}_{k}"] + F.shiftrightunsigned(s[f"p{p}"], k).bitwiseAND(F.lit(_LANES))).alias(f"s{p}_{k}"))
        return F.struct(*out)

    def finish(a: Column) -> Column:
        wide = [_wrapping_add(F.shiftleft(a[f"h{k}"], 32), a[f"l{k}"]) for k in range(WIDE)]
        return F.array(a["n"], *wide, *[a[f"s{p}_{k}"] for p in range(PACKS) for k in range(32)])

    return F.aggregate(per, start, step, finish)


def inserted(print_: Column, paragraph: Column) -> Column:
    """Fingerprint after a paragraph (as :func:`paragraphs` gives it) is added."""
    return added(print_, paragraph_vector(paragraph))


def deleted(print_: Column, paragraph: Column) -> Column:
    """Fingerprint after a paragraph is taken away."""
    negative = F.transform(paragraph_vector(paragraph), lambda x: _wrapping_add(F.bitwise_not(x), F.lit(1).cast("long")))
    return added(print_, negative)


def _centred(print_: Column) -> Column:
    """Components of -1 and 1 summed over the paragraphs, as an array of double."""
    words = F.slice(print_, 2 + WIDE, 32 * PACKS)
    lanes = F.flatten(F.transform(words, lambda w: F.array(*[F.shiftrightunsigned(w, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(2)])))
    return F.transform(lanes, lambda x: (2 * x - print_[0]).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets of paragraphs, from 0 to 1; 1 for equal fingerprints.

    Against an empty text, but for an empty one, it is 0.  The standard error is about 0.09.
    """
    x, y = _centred(a), _centred(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm)))


def as_text(print_: Column) -> Column:
    """Fingerprint as one string: 16 hexadecimal digits for each word."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Rows with ``next_<c>`` for each of ``columns``: its value in the next row by descending ``doc_id``.

    After the last row comes the first.  Rows that share an id stand in the order of a hash of their texts,
    the greatest first; null ids stand last.  Ids are cut into ranges by approximate quantiles, of which at
    most ``ranges`` numbers reach the driver; an id that fills several ranges, or the null id, is cut further
    by the hash.  Each range also gets a copy of the first row of the range that follows.  So one sort within
    each range does, and no task has more than its share, but for rows that are equal in id and text.
    """
    spark = docs.sparkSession
    ranges = ranges or min(2000, 4 * shuffle_partitions(spark))
    docs = docs.withColumn("_h", F.xxhash64("text"))
    id_, h = F.col("doc_id"), F.col("_h")
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges), F.count(F.lit(1)), F.count("doc_id")).first()
    times: dict[int, int] = {}
    for c in found[0] or []:
        times[c] = times.get(c, 0) + 1
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")
    cuts, many = sorted(times), [c for c in sorted(times) if times[c] > 1]
    nulls = 1 + ranges * (found[1] - found[2]) // max(found[1], 1)
    # Ranges are numbered by falling id: so many cuts are greater, then the parts of one id.
    part = F.get(longs([times[c] for c in many]), F.array_position(longs(many), id_).cast("int") - 1)
    part = F.when(id_.isNull(), F.lit(nulls)).otherwise(part)
    inside = F.when(part.isNull(), F.lit(0)).otherwise(1 + F.floor((0.5 - h / F.lit(2.0**64)) * part))
    number = F.when(id_.isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(longs(cuts), lambda c: c > id_))).cast("long") * 4096 + inside
    heads = sorted(docs.select(number.alias("r"), F.struct("doc_id", "_h").alias("head")).groupBy("r").agg(F.max("head").alias("head")).collect())  # one row a range
    table = spark.createDataFrame([(head["head"][0], head["head"][1], heads[k - 1]["r"]) for k, head in enumerate(heads)], "_head long, _head_h long, _before long")
    own = F.struct(number.alias("_r"), F.lit(False).alias("_copy"))
    both = F.array(own, F.struct(F.col("_before").alias("_r"), F.lit(True).alias("_copy")))
    rows = docs.join(F.broadcast(table), id_.eqNullSafe(F.col("_head")) & (h == F.col("_head_h")), "left")  # a row a range
    rows = rows.withColumn("_to", F.when(F.col("_before").isNull(), F.array(own)).otherwise(both)).select(*docs.columns, F.explode("_to").alias("_to"))
    order = Window.partitionBy("_to._r").orderBy("_to._copy", id_.desc_nulls_last(), h.desc(), F.col("text"))
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not _to._copy").drop("_to", "_h")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and how alike fingerprints are.

    In the edited text the last floor(n/2) code points are replaced by the first as many (or all) of the
    next document.  Null texts count as empty.  Rows: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  Repeated rows and null ids are kept; other columns are
    left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("print", fingerprint(F.col("text"))), ["text", "print"])
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    out = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "print", "next_print")
    out = out.withColumn("edited_print", fingerprint(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
