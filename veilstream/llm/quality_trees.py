"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics_of`` turns whole texts into numbers (shares of kinds of characters, word and line shapes, repetition)
with NumPy, many documents at a time. Trees are grown level by level on binned statistics from a bounded sample
of labelled rows (``SAMPLE``, those with the smallest hash of doc_id, found from ids alone) and flattened into three arrays, so that
scoring a batch is ``depth`` array look-ups per tree. The label, lang, source and doc_id are no inputs.

Rows whose crc32 of doc_id mod 3 is 1 are held out: their labels are never learned from.

Defined cases: null texts are scored as empty ones. Labels without a quality are ignored; repeated labels all
count. Without labels, or with labels of one kind only, every score is the (smoothed) share of label 1.
Other columns are ignored by ``quality_scores`` and kept by ``drop_low_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.words import SPACE, tidy, word_pieces
from veilstream.session import cut_lineage, if_small

SAMPLE, BINS = 20_000, 64
KINDS = ("lower", "upper", "digit", "space", "line", "stop", "comma", "mark", "quote", "symbol", "lead", "rest")
NAMES = ("chars", "words", "word_mean", "word_sd", "long_words", "distinct", "top_word", "repeated_pairs", "repeated_runs",
         "capital_words", "symbol_words", "stopped_words", "lines", "line_words", "repeated_lines", "longest_line", "entropy",
         *(f"share_{k}" for k in KINDS))


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("symbol"), np.uint8)
    for b in range(256):
        c = chr(b)
        kind = ("rest" if 0x80 <= b < 0xC0 else "lead" if b >= 0xC0 else "lower" if c.islower() else "upper" if c.isupper() else
                "digit" if c.isdigit() else "line" if c == "\n" else "space" if b in (32, 9, 11, 12, 13) else
                "stop" if c == "." else "comma" if c in ",;:" else "mark" if c in "!?" else "quote" if c in "'\"()-" else "symbol")
        table[b] = KINDS.index(kind)
    return table


KIND = _kinds()


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many different values, and how often the most frequent one occurs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, int)
    top = np.zeros(n)
    np.maximum.at(top, owner[head], np.diff(np.append(head, len(h))))
    return np.bincount(owner[head], minlength=n).astype(float), top


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    rows = [np.zeros((0, len(NAMES)))]
    for a, b, words in word_pieces(column, SPACE):
        n, first, data = b - a, words.first, words.data
        counts = np.diff(first)
        owner = np.repeat(np.arange(n), counts)
        size = words.end - words.start
        kinds = KIND[data]
        text_owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(words.offsets))
        by_kind = np.bincount(text_owner * len(KINDS) + kinds, minlength=n * len(KINDS)).reshape(n, -1).astype(float)
        chars = by_kind.sum(1) - by_kind[:, KINDS.index("rest")]

        def within(mask):  # bytes of each word for which mask holds
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[words.end] - total[words.start]
        letters = within((kinds == 0) | (kinds >= KINDS.index("lead")))
        capitals, symbols = within(kinds == 1), within((kinds == KINDS.index("symbol")) | (kinds == KINDS.index("mark")))
        distinct, top = _repeats(words.h, owner, n)
        shapes = {}
        for length in (2, 5):
            grams, valid = words.grams(length)
            different, _ = _repeats(grams[valid], owner[valid], n)
            shapes[length] = 1 - _ratio(different, np.maximum(counts - length + 1, 0))
            shapes[length][counts < length] = 0
        # lines: words between line ends
        line = np.cumsum(kinds == KINDS.index("line"))[words.start] + owner if len(owner) else np.zeros(0, int)
        start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, int)
        line_words = np.diff(np.append(start, len(line)))
        line_hash = np.add.reduceat(words.h * (np.arange(len(line)) - np.repeat(start, line_words) + 1).astype(np.uint64), start) \
            if len(line) else np.zeros(0, np.uint64)
        lines = np.bincount(owner[start], minlength=n).astype(float)
        different, _ = _repeats(line_hash, owner[start], n)
        longest = np.zeros(n)
        np.maximum.at(longest, owner[start], line_words)
        mean = _ratio(_sums(size, first), counts)
        square = _ratio(_sums(size.astype(float) ** 2, first), counts)
        shares = by_kind / np.maximum(by_kind.sum(1, keepdims=True), 1)
        bins = np.bincount(text_owner * 32 + (data >> 3), minlength=n * 32).reshape(n, 32) / np.maximum(by_kind.sum(1, keepdims=True), 1)
        entropy = -(bins * np.log2(np.where(bins > 0, bins, 1))).sum(1)
        rows.append(np.column_stack([
            np.log1p(chars), np.log1p(counts), mean, np.sqrt(np.maximum(square - mean ** 2, 0)), _ratio(_sums(size > 20, first), counts),
            _ratio(distinct, counts), _ratio(top, counts), shapes[2], shapes[5],
            _ratio(_sums((capitals > 1) & (letters == 0), first), counts), _ratio(_sums(symbols > 0, first), counts),
            _ratio(_sums(kinds[words.end - 1] == KINDS.index("stop"), first), counts) if len(size) else np.zeros(n),
            np.log1p(lines), _ratio(counts, lines), 1 - _ratio(different, np.maximum(lines, 1)) - (lines == 0),
            np.log1p(longest), entropy, shares]))
    return np.concatenate(rows)


class Trees:
    """Boosted trees of one depth as arrays: ``feature`` and ``cut`` of inner nodes, ``leaf`` values."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        depth, total = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0, np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 5.0,
         ridge: float = 1.0) -> Trees:
    """Trees that minimise the logistic loss of labels ``y`` (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2 ** depth - 1
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    total, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best, at = np.full(width, 1e-9), np.zeros((width, 2), int)
            where = node - first
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = len(c) + 1
                g, h = (np.bincount(where * bins + binned[:, j], w, width * bins).reshape(width, bins) for w in (slope, bend))
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                at[better] = np.column_stack([np.full(width, j), k])[better]
            split = best > 1e-9
            feature[first:first + width] = np.where(split, at[:, 0], 0)
            cut[first:first + width] = [cuts[j][k] if s else np.inf for (j, k), s in zip(at, split)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        where = node - inner
        g, h = (np.bincount(where, w, inner + 1) for w in (slope, bend))
        leaf[:] = -rate * g / (h + ridge)
        total += leaf[where]
        trees.append((feature, cut, leaf))
    return Trees(base, *(np.stack(t) for t in zip(*trees)))


def held_out(doc_id="doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` with the statistics of every row as an array."""
    def run(batches):
        for batch in batches:
            x = statistics_of(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))],
                ["doc_id", "x"])
        tidy()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def _bound(hashed: DataFrame, wanted: int) -> int | None:
    """A bound that at least ``wanted`` of the hashes ``h`` do not exceed, and fewer than twice as many unless hashes are
    equal; none if there are no more hashes than that. Counts of 16 bits of the hash at a time reach the driver."""
    need = wanted
    for shift in (48, 32, 16, 0):
        counts = sorted(map(tuple, hashed.groupBy(F.shiftright("h", shift).alias("at")).count().collect()))
        if sum(n for _, n in counts) <= need:
            return None
        for at, n in counts:
            if n >= need:
                break
            need -= n
        if n <= wanted or not shift:
            return ((at + 1) << shift) - 1
        hashed = hashed.where(F.shiftright("h", shift) == at)
    return None


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> Trees:
    """Trees for ``labels(doc_id, quality)`` outside the held-out rows, from at most ``sample`` of them."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ids first: texts are read, and statistics computed, of the sampled rows alone.
    bound = _bound(known.join(docs.select("doc_id"), "doc_id").select(F.xxhash64("doc_id").alias("h")), sample)
    if bound is not None:
        known = known.where(F.xxhash64("doc_id") <= F.lit(bound))
    known = cut_lineage(known)
    ids, _ = if_small(cut_lineage(known.select("doc_id").distinct()))
    rows = statistics(docs.join(ids, "doc_id", "left_semi")).join(known, "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).toPandas()
    x = np.stack(list(rows["x"])) if len(rows) else np.zeros((0, len(NAMES)))
    return grow(x, rows["y"].to_numpy(float), **settings)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``."""
    trees = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(trees.score(statistics_of(batch["text"])))], ["doc_id", "score"])
        tidy()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    trees = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(trees.score(statistics_of(batch["text"])) >= 0.5))
        tidy()
    return docs.mapInArrow(run, docs.schema)
