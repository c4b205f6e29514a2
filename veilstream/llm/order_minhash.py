"""Order MinHash fingerprints of whole texts (DataFrame functions only).

A text is the sequence of its words; its k-mers are ``gram`` consecutive words (a shorter text is one k-mer).
Each k-mer is numbered by its occurrence, so repetitions count, and hashed with that number. The hash circle
has ``places`` evenly spaced marks; from each mark on the ``kept`` next hashes are the minimal ones under the
hash order turned to that mark. They are put back into text order and the tuple is hashed to one position of
the fingerprint. Texts with the same words in another order share minimal k-mers but not their order, so the
share of equal positions falls with edit distance, not only with the words in common.

Everything about one text happens inside its row: arrays, no exploded k-mers, no shuffle. Occurrence numbers
come from the sorted k-mers as running numbers of equal neighbours.

``edited_fingerprints`` needs the next document in descending doc_id. Documents are dealt to ranges of doc_id
(approximate quantiles: only sizes depend on them), each range is sorted once, and only the first document of
each range is looked up from the range above it.

Defined cases: null and empty texts have no k-mers; all positions are then the same empty mark, equal only to
another text without words. Rows with one doc_id follow each other by text. A null doc_id comes last. A single
document is its own next. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES, KEPT, GRAM = 16, 3, 2
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def occurrence_numbered(text: Column, gram: int = GRAM) -> Column:
    """Sorted array of ``(v, i)``: the hash of every k-mer with its occurrence number, and its place."""
    def kmers(words):
        whole = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
        heads = F.slice(words, F.lit(1), F.size(words) - (gram - 1))
        many = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, gram))))
        return F.when(F.size(words) < gram, whole).otherwise(many)

    def numbered(placed):  # sorted (h, i): equal k-mers stand together in text order
        heads = F.filter(F.transform(placed, lambda p, j: F.when(
            (j == 0) | (p["h"] != F.get(placed, j - 1)["h"]), j)), lambda j: j.isNotNull())
        numbers = _let(heads, lambda s: F.flatten(F.transform(s, lambda a, k: F.sequence(
            F.lit(0), F.coalesce(F.get(s, k + 1), F.size(placed)) - a - 1))))
        return _let(numbers, lambda o: F.sort_array(F.transform(placed, lambda p, j: F.struct(
            F.xxhash64(p["h"], F.get(o, j)).alias("v"), p["i"].alias("i")))))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    hashes = _let(words, kmers)
    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), numbered)


def fingerprint(text: Column, places: int = PLACES, kept: int = KEPT, gram: int = GRAM) -> Column:
    """``places`` numbers as 16 hexadecimal digits each. ``places`` is a power of two."""
    shift = 64 - (places.bit_length() - 1)

    def positions(found):
        turn = F.concat(found, F.slice(found, 1, kept))  # the circle closes
        sector = F.transform(found, lambda f: F.pmod(F.shiftright(f["v"], shift), F.lit(places)).cast("int"))
        # v is sorted as a signed number, so sectors run from places / 2 to places - 1 and on from 0
        marks = [(places // 2 + r) % places for r in range(places)]

        def starts(sectors):
            return F.array(*(F.array_position(sectors, F.lit(m)).cast("int") for m in marks))

        def signature(begin):
            def one(_, r):
                at = F.coalesce(F.get(F.filter(F.slice(begin, r + 1, F.lit(places)), lambda x: x > 0), F.lit(0)), F.lit(1))
                return _let(F.slice(turn, at, F.lit(kept)), lambda s: F.xxhash64(F.transform(
                    F.sort_array(F.transform(s, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])))
            return F.transform(begin, one)
        return F.array_join(F.transform(_let(_let(sector, starts), signature),
                                        lambda v: F.lpad(F.hex(v), 16, "0")), "")
    return _let(occurrence_numbered(text, gram), positions)


def likeness(a, b, places: int = PLACES) -> Column:
    """Share of equal positions of two fingerprints, 0 to 1."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    same = [(F.substring(a, 1 + 16 * p, 16) == F.substring(b, 1 + 16 * p, 16)).cast("int") for p in range(places)]
    return sum(same[1:], same[0]) / F.lit(float(places))


def fingerprints(docs: DataFrame, places: int = PLACES, kept: int = KEPT, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
                       fingerprint(text, places, kept, gram).alias("fingerprint"))


def with_next(docs: DataFrame, value: Column, ranges: int | None = None) -> DataFrame:
    """``(doc_id, doc, next)`` of rows ``(doc_id, text)``: the struct ``value``, which has the text, of the row and of the next one in
    descending doc_id; the last row is followed by the first. One shuffle of the rows."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("doc.text"))
    # the first row of every range: by id, then by text
    heads = docs.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head"))
    least = Window.orderBy(F.col("bucket").desc())
    heads = heads.select(F.col("head").alias("h"), F.coalesce(
        F.lag("bucket").over(least), F.min("bucket").over(Window.partitionBy())).alias("before"))
    # one row for each range, so their number is bounded by ``ranges``
    first = (docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("h"))).groupBy("before")
             .agg(F.min("text").alias("text")).select(F.col("before").alias("bucket"), value.alias("first")))
    rows = docs.select("doc_id", "bucket", value.alias("doc")).withColumn("next", F.lead("doc").over(order))
    rows = rows.join(first, "bucket", "left")
    return rows.select("doc_id", "doc", F.coalesce("next", "first").alias("next"))


def edited_fingerprints(docs: DataFrame, places: int = PLACES, kept: int = KEPT, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``: the edited
    text ends in the beginning of the next document instead of its own last half."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = with_next(rows, F.struct("text", fingerprint(F.col("text"), places, kept, gram).alias("fp")))
    n = F.length("doc.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("doc.text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("doc.fp").alias("fingerprint"),
                       F.col("next.fp").alias("next_fp"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"), places, kept, gram))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint", places).alias("near_edited"),
                       likeness("fingerprint", "next_fp", places).alias("near_next"))
