"""Ranked lexical search with bag deduplication.

A document is a bag of terms; what a search sees of it is the part of the bag whose terms occur in an item, and
its length. Documents that agree in both get the same score from every item, so they are one *class*:

1. *Statistics.* One pass counts documents, terms, and for every term of the items the documents that hold it.
2. *Classes.* A second pass restricts every document to the items' vocabulary: a vector of term frequencies and
   its length measure m. Equal (vector, m) are merged inside a task before anything is sent, and then dealt by a
   64-bit hash. Rows with one hash are sorted next to each other and compared whole, so a clash of hashes makes
   no class. Of a class only its ``top`` smallest doc_ids matter: its members have equal scores, so no other
   member can be among the ``top`` best.
3. *Scores.* Every class is scored once for every item, in blocks of ``CLASSES``; its members take its score in
   ascending order. Each task keeps ``top`` rows for an item, and the best of these are the result.

Scores are exact 64-bit integers. Terms are compared by hash and then byte by byte.

Items are searched in blocks of at most ``block_chars`` characters (a longer item is a block of its own): only
one block at a time is on the driver and in the tasks, and its result is written before the next is read.

Defined cases: null, empty and wordless texts hold no term, score nothing and are not counted in N. Rows that
share a doc_id are documents of their own; a null doc_id comes after all others. Items that share an item_id
are one item with the terms of all of them, and those without an id are one item too; items without terms find
nothing. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.words import SYMBOL, Words, flat, ranges, tidy, word_pieces
from veilstream.session import cut_lineage

TOP, BLOCK_CHARS = 10, 1_000_000
CLASSES = 512            # classes scored side by side
FLUSH = 8_000_000        # bytes of vectors that a task merges before it sends them
PART = 100_000           # documents of a partition of classes
NO_ID = np.iinfo(np.int64).max
VECTORS = pa.schema([("hash", pa.int64()), ("m", pa.int64()), ("terms", pa.binary()), ("freqs", pa.binary()),
                     ("ids", pa.binary()), ("nameless", pa.int32())])
VECTOR_TYPES = "hash long, m long, terms binary, freqs binary, ids binary, nameless int"


class Vocabulary:
    """The distinct terms of a block of items, numbered in the order of their hashes."""

    def __init__(self, items: dict):
        texts = [t or "" for own in items.values() for t in own]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        words = Words(data, offsets, SYMBOL, True)
        self.h, first = np.unique(words.h, return_index=True)
        self.length = words.end[first] - words.start[first]
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.data = words.data[ranges(words.start[first], self.length)]
        term, self.names, self.terms, text = np.searchsorted(self.h, words.h), list(items), [], 0
        for own in items.values():
            self.terms.append(np.unique(term[words.first[text]:words.first[text + len(own)]]))
            text += len(own)

    def __len__(self) -> int:
        return len(self.h)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(word, term)`` of every word that is a term of the vocabulary."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.h, words.h), len(self) - 1)
        word = np.flatnonzero(self.h[at] == words.h)
        term, start = at[word], words.start[word]
        good = words.end[word] - start == self.length[term]
        word, term, start = word[good], term[good], start[good]
        size = self.length[term]
        differs = words.data[ranges(start, size)] != self.data[ranges(self.begin[term], size)]
        if differs.any():
            wrong = np.add.reduceat(differs, np.concatenate([[0], np.cumsum(size)[:-1]])) > 0
            word, term = word[~wrong], term[~wrong]
        return word, term


def _bags(column: pa.Array, vocabulary: Vocabulary):
    """``(first row, terms of each row, row, term, frequency)`` of pieces of a column, by row and term."""
    for a, _, words in word_pieces(column, SYMBOL, lower=True):
        word, term = vocabulary.find(words)
        row = np.searchsorted(words.first, word, side="right") - 1
        pair, tf = np.unique(row * np.int64(len(vocabulary) or 1) + term, return_counts=True)
        yield a, np.diff(words.first), pair // (len(vocabulary) or 1), pair % (len(vocabulary) or 1), tf


def _statistics(vocabulary: Vocabulary):
    """Sums of a task: documents with terms (-1), terms (-2), documents that hold each term."""
    def run(batches):
        df, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, sizes, _, term, _ in _bags(batch["text"], vocabulary):
                df += np.bincount(term, minlength=len(vocabulary)).astype(np.int64)
                documents, total = documents + int((sizes > 0).sum()), total + int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], held)), pa.array(np.append([documents, total], df[held]))],
                                         ["term", "n"])
        tidy()
    return run


def _vectors(vocabulary: Vocabulary, documents: int, total: int, top: int):
    """Classes of the rows of a task with their smallest ids, merged per ``FLUSH``."""
    narrow = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32

    def batch_of(held: dict):
        m, terms, freqs = ([k[i] for k in held] for i in range(3))
        code = Words(np.frombuffer(b"".join(t + f for t, f in zip(terms, freqs)), np.uint8),
                     np.cumsum([0] + [len(t) + len(f) for t, f in zip(terms, freqs)]), np.zeros(256, bool), False)
        ids = [np.sort(np.array(v[0], np.int64))[:top].tobytes() for v in held.values()]
        return pa.RecordBatch.from_arrays([
            pa.array((code.h ^ np.array(m, np.int64).astype(np.uint64)).view(np.int64)), pa.array(m, pa.int64()), pa.array(terms, pa.binary()),
            pa.array(freqs, pa.binary()), pa.array(ids, pa.binary()), pa.array([min(v[1], top) for v in held.values()], pa.int32())], schema=VECTORS)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for a, sizes, row, term, tf in _bags(batch["text"], vocabulary):
                edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else ()
                for i, j in zip(edges, np.append(edges[1:], len(row)) if len(row) else ()):
                    n, name, times = int(sizes[row[i]]), ids[a + int(row[i])], tf[i:j]
                    most = int(times.max())
                    kind = np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64
                    key = 10 + 90 * n * documents // total, term[i:j].astype(narrow).tobytes(), times.astype(kind).tobytes()
                    own = held.get(key)
                    if own is None:
                        own = held[key] = [[], 0]
                        size += len(key[1]) + len(key[2]) + 100
                    if name is None:
                        own[1] += 1
                    else:
                        own[0].append(name)
                        if len(own[0]) > 8 * top:
                            own[0] = sorted(own[0])[:top]
                if size >= FLUSH:
                    yield batch_of(held)
                    held, size = {}, 0
        if held:
            yield batch_of(held)
        tidy()
    return run


def _best(vocabulary: Vocabulary, weights: np.ndarray, top: int, kind):
    """Scores sorted classes and keeps the ``top`` documents of every item."""
    narrow = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
    own = [(t, weights[t]) for t in vocabulary.terms]
    kinds = {1: np.uint8, 4: np.uint32, 8: np.uint64}

    def keep(best, scores, members):
        """Merges the members of a block of classes into the best of every item."""
        for i, score in enumerate(scores):
            floor = best[i][0][-1] if len(best[i][0]) == top else 1
            good = np.flatnonzero(score >= max(floor, 1))
            if len(good):
                ids = [members[c] for c in good]
                found = np.repeat(score[good], [len(x) for x in ids])
                values = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], *(x["id"] for x in ids)]), np.concatenate([best[i][2], *(x["no"] for x in ids)])
                order = np.lexsort((values[1], values[2], -values[0]))[:top]
                best[i] = tuple(v[order] for v in values)

    def score(block):
        frequency = np.zeros((len(vocabulary), len(block)), np.int64)
        term = np.frombuffer(b"".join(c[1] for c in block), narrow)
        count = np.array([len(c[1]) // narrow().itemsize for c in block])
        tf = flat([np.frombuffer(c[2], kinds[len(c[2]) // n]).astype(np.int64) for c, n in zip(block, count)])
        m = np.repeat(np.array([c[0] for c in block], np.int64), count)
        frequency[term, np.repeat(np.arange(len(block)), count)] = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        return [w @ frequency[t] for t, w in own]

    def joined(parts):
        """The ``top`` smallest ids of a class, those without an id last."""
        ids = np.sort(np.frombuffer(b"".join(p[0] for p in parts), np.int64))[:top]
        nameless = min(sum(p[1] for p in parts), top - len(ids))
        out = np.zeros(len(ids) + nameless, [("id", np.int64), ("no", np.int8)])
        out["id"][:len(ids)], out["id"][len(ids):], out["no"][len(ids):] = ids, NO_ID, 1
        return out

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)) for _ in own]
        block, at, same = [], None, {}

        def settle(final=False):
            block.extend((*key, joined(parts)) for key, parts in same.items())
            same.clear()
            while len(block) >= CLASSES or final and block:
                now = block[:CLASSES]
                del block[:CLASSES]
                keep(best, score(now), [c[3] for c in now])
        for batch in batches:
            for h, m, terms, freqs, ids, nameless in zip(*(batch[c].to_pylist() for c in VECTORS.names)):
                if h != at:
                    settle()
                    at = h
                parts = same.setdefault((m, terms, freqs), [])
                parts.append((ids, nameless))
                if len(parts) > 1000:
                    whole = joined(parts)
                    parts[:] = [(whole["id"][whole["no"] == 0].tobytes(), int((whole["no"] == 1).sum()))]
        settle(final=True)
        for i, (scores, ids, no) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array([vocabulary.names[i]] * len(scores), kind), pa.array(np.full(len(scores), i, np.int32)),
                    pa.array(ids, mask=no == 1), pa.array(scores)], ["item_id", "item", "doc_id", "score"])
        tidy()
    return run


def _blocks(benchmark: DataFrame, block_chars: int):
    """``{item_id: texts}`` of about ``block_chars`` characters, one block after the other."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for i in range(n):
        items: dict = {}
        for name, text in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)).collect():
            items.setdefault(name, []).append(text)
        yield items


def _searched(rows: DataFrame, items: dict, id_type, top: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    vocabulary = Vocabulary(items)
    counted = rows.select("text").mapInArrow(_statistics(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n"))
    sums = dict(map(tuple, counted.collect()))  # one number for each term of the block
    documents, total = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * sums.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-documents // PART))
    classes = rows.mapInArrow(_vectors(vocabulary, documents, total, top), VECTOR_TYPES).repartition(parts, "hash").sortWithinPartitions("hash")
    best = classes.mapInArrow(_best(vocabulary, weights, top, to_arrow_type(id_type)), f"item_id {id_type.simpleString()}, item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best of ``docs(doc_id, text)`` for each of
    ``items(item_id, text)``, equal scores by ascending doc_id. Counts the documents at once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    id_type = items.schema["item_id"].dataType
    found = [cut_lineage(_searched(rows, own, id_type, top)) for own in _blocks(items, block_chars)]
    return reduce(DataFrame.unionByName, found)
