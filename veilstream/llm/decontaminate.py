"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ``window`` consecutive words of the benchmark items; an item of fewer words is
one test string. Strings of one length share three tables over blocks of consecutive words: how far a search
may shift when it meets a block (the smallest distance from that block to the end of a string; a block in none
of them shifts past it), and, for blocks that end a string, the strings to compare. What the tables let
through is compared word by word and then byte by byte. Documents are searched in lanes of ``LANE`` words side
by side with NumPy; lanes overlap by a string's length, so nothing depends on where they start.

The documents are never shuffled. The benchmark goes to the tasks in blocks of at most ``block_chars``
characters (a longer single item makes a longer block). Each block is one more pass over the documents, whose marks
are written before the next block is read: at any time one block is on the driver and in the tasks.

Defined cases: null and empty texts have no words. Items without words are no test strings; items with one id are
one item, and so are those without an id: it counts, and its id in the list of ids is empty. Rows that share a doc_id are judged each by itself. Other columns are ignored
by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from veilstream.llm.words import SYMBOL, Words, flat, ranges, word_pieces
from veilstream.session import cut_lineage

WINDOW, BLOCK, LANE, BLOCK_CHARS = 13, 3, 128, 4_000_000
SPANS, ITEMS = "__hit_spans", "__hit_items"


class Patterns:
    """Distinct test strings of one length with the tables of the search."""

    def __init__(self, length: int, strings: dict[bytes, set[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.texts, self.items = list(strings), [sorted(x) for x in strings.values()]
        text = b"".join(self.texts)
        ends = np.cumsum([0] + [len(t) for t in self.texts])
        words = Words(np.frombuffer(text, np.uint8), ends, SYMBOL, False)
        self.h = words.h.reshape(len(self.texts), length)
        blocks, valid = words.grams(self.block)
        blocks = blocks[valid].reshape(len(self.texts), length - self.block + 1)
        bits = min(24, max(12, int(blocks.size * 16).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint16)
        for j in range(blocks.shape[1]):  # from the front, so the smallest distance remains
            at = blocks[:, j] & self.mask
            self.shift[at] = np.minimum(self.shift[at], blocks.shape[1] - 1 - j)
        self.order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix = blocks[self.order, -1]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(first word, string)`` of every occurrence."""
        first, stop = words.first[:-1], words.first[1:] - self.length + 1  # where a window may start
        room = np.maximum(stop - first, 0)
        lanes = -(-room // LANE)
        at = np.repeat(first, lanes) + ranges(np.zeros(len(lanes), np.int64), lanes) * LANE
        end = np.minimum(at + LANE, np.repeat(stop, lanes))
        blocks, _ = words.grams(self.block)
        tail, found = self.length - self.block, []
        while len(at):
            step = self.shift[blocks[at + tail] & self.mask].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        at = flat(found).astype(np.int64)
        low = np.searchsorted(self.suffix, blocks[at + tail])
        count = np.searchsorted(self.suffix, blocks[at + tail], side="right") - low
        string, at = self.order[ranges(low, count)], np.repeat(at, count)
        for j in range(self.length):
            same = words.h[at + j] == self.h[string, j]
            string, at = string[same], at[same]
        exact = np.array([b" ".join([words.bytes(i, i + 1) for i in range(a, a + self.length)]) == self.texts[s]
                          for a, s in zip(at.tolist(), string.tolist())], bool)
        return at[exact], string[exact]


def test_strings(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    by_length: dict[int, dict[bytes, set[str]]] = {}
    for name, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), SYMBOL, True)
        n = len(words.h)
        size = min(n, window)
        parts = [words.bytes(i, i + 1) for i in range(n)]
        for i in range(n - size + 1 if n else 0):
            by_length.setdefault(size, {}).setdefault(b" ".join(parts[i:i + size]), set()).add(name)
    return [Patterns(size, strings) for size, strings in sorted(by_length.items())]


test_strings.__test__ = False


def _searched(column: pa.Array, patterns: list[Patterns]):
    """Of every row: number of words, word ranges hit, ids of the items found."""
    for a, b, words in word_pieces(column, SYMBOL, lower=True):
        spans, items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
        for p in patterns:
            at, string = p.find(words)
            rows = np.searchsorted(words.first, at, side="right") - 1
            for row, i, s in zip(rows.tolist(), at.tolist(), string.tolist()):
                begin = i - int(words.first[row])
                spans[row].append((begin, begin + p.length))
                items[row].update(p.items[s])
        for n, span, names in zip(np.diff(words.first).tolist(), spans, items):
            yield n, span, names


def _covered(spans: list[tuple[int, int]]) -> int:
    total, at = 0, 0
    for start, stop in sorted(spans):
        total += max(0, stop - max(at, start))
        at = max(at, stop)
    return total


def _blocks(benchmark: DataFrame, block_chars: int, window: int):
    """``(whether it is the last, test strings)`` of blocks of about ``block_chars`` characters, one after the other."""
    rows = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield i == n - 1, test_strings([(r.item, r.text) for r in part.collect()], window)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int, last) -> DataFrame:
    """Runs every block over the rows; ``last(batch, n_words, spans, items)`` makes the final batch."""
    finish, schema = last
    carried = StructType([*docs.schema.fields, StructField(SPANS, BinaryType()), StructField(ITEMS, ArrayType(StringType()))])
    for k, (final, patterns) in enumerate(_blocks(benchmark, block_chars, window)):
        def run(batches, patterns=patterns, first=k == 0, final=final):
            for batch in batches:
                found = list(_searched(batch["text"], patterns))
                spans, items = [f[1] for f in found], [f[2] for f in found]
                if not first:
                    spans = [s + [(int(a), int(b)) for a, b in np.frombuffer(x, np.int64).reshape(-1, 2)] for s, x in zip(spans, batch[SPANS].to_pylist())]
                    items = [s | set(x) for s, x in zip(items, batch[ITEMS].to_pylist())]
                    batch = batch.select([c for c in batch.schema.names if c not in (SPANS, ITEMS)])
                if final:
                    yield finish(batch, [f[0] for f in found], spans, items)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array([np.array(s, np.int64).tobytes() for s in spans], pa.binary()),
                         pa.array([sorted(s) for s in items], pa.list_(pa.string()))], [*batch.schema.names, SPANS, ITEMS])
        docs = docs.mapInArrow(run, schema) if final else cut_lineage(docs.mapInArrow(run, carried))
    return docs


def _report(batch, n_words, spans, items):
    n_hit = [_covered(s) for s in spans]
    digest = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array([len(s) for s in items], pa.int64()), pa.array(digest, pa.string()),
         pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of ``docs(doc_id, text)``:
    contaminated where at least a twentieth of the words, and at least one, lie in test strings."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _marked(rows, benchmark, window, block_chars, (
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    def clean(batch, n_words, spans, items):
        hit = [_covered(s) for s in spans]
        return batch.filter(pa.array([not (h > 0 and 20 * h >= n) for h, n in zip(hit, n_words)], pa.bool_()))
    return _marked(docs, benchmark, window, block_chars, (clean, docs.schema))
