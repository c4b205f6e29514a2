"""Spelling variants by dynamic programming over sorted lists.

*Words.* Maximal runs of letters are counted per task (exactly, as Arrow strings) and added up; ``noisy_runs``
says which of them first lose a letter. The vocabulary keeps words of ``MIN_LENGTH`` code points and
``MIN_COUNT`` occurrences.

*Lists.* Two words one edit apart agree before the edit and behind it, so they share the first half of the
shorter one or the last half of it. A word therefore goes to the lists of its own half and of the half that it
has as the longer of a pair, from the front and, reversed, from the back. A list that would hold more than
``LIST`` words is dealt once more by a further quarter, with the same argument inside the other half. Lists are
dealt to tasks by their name and sorted there; nobody holds the vocabulary.

*Scan.* Every word runs down its sorted list with one banded row (three cells) of the edit matrix per depth.
The next list entry reuses the rows up to its common prefix with the entry before; when a row has no cell of
at most one edit, all following entries that share this prefix are skipped at once. Many words of many lists
scan side by side as NumPy lanes. A pair that meets in several lists counts in the first of them only.

*Forms.* Pairs are reduced inside a task to the number and the best of a word's neighbours. Roots follow forms
by doubling: occurrences grow at least by ``RATIO`` from form to form, so there are no circles and few steps.

Defined cases: null texts have no runs; a null doc_id is an empty text in the hash; rows that share a doc_id
are documents of their own; a word may be as long as it likes. Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.words import LOWER, pieces, ranges, tidy
from veilstream.session import cut_lineage

MIN_LENGTH, MIN_COUNT, RATIO, DIVISOR = 6, 5, 5, 199
FLUSH = 400_000          # distinct words that a task holds
LIST = 20_000            # words of a list before it is dealt by a further quarter
CELLS = 4_000_000        # matrix cells of the words that scan side by side
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32_from(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:start + length]`` of every element, going on from the checksum ``state``."""
    order = np.argsort(-length, kind="stable")
    start, crc = start[order], ~state.astype(np.uint32)[order]
    falling = -length[order]
    for j in range(int(length.max()) if len(length) else 0):
        live = int(np.searchsorted(falling, -j, side="left"))  # those longer than j come first
        crc[:live] = CRC[(crc[:live] ^ data[start[:live] + j]) & 0xFF] ^ crc[:live] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """``(lowered data, first byte, bytes, code points, document)`` of maximal runs of A-Z, a-z, U+00C0 to U+00FF."""
    data = LOWER[data]
    n = len(data)
    lead = data == 0xC3  # together with its next byte this is U+00C0 to U+00FF
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = (data >= 97) & (data <= 122) | lead
    inside[2:-1] |= lead[:-1]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]  # a run never goes on into the next document
    begins[bounds] = inside[bounds + 1]
    ends[bounds - 1] = inside[bounds]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return data, start, stop - start, stop - start - (leads[stop] - leads[start]), np.searchsorted(offsets, start, side="right") - 1


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    letters = np.ascontiguousarray(data[ranges(start, length)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters))


def noisy_runs(column: pa.Array, ids: list, least: int, divisor: int):
    """Arrays of the runs of some documents that have at least ``least`` code points after each run whose hash
    is a multiple of ``divisor`` lost a letter."""
    for a, b, data, offsets in pieces(column):
        data, start, length, points, document = letter_runs(data, offsets)
        long = points >= least
        start, length, points, document = start[long], length[long], points[long], document[long]
        if not len(start):
            continue
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[a:b]], np.uint32)
        h = crc32_from(heads[document], data, start, length)
        marked = h % np.uint32(divisor) == 0
        yield _strings(data, start[~marked], length[~marked])
        changed = []
        for i in np.flatnonzero(marked).tolist():
            run = data[start[i]:start[i] + length[i]].tobytes().decode()
            at = int(h[i]) % len(run)
            if len(run) > least:
                changed.append(run[:at] + run[at + 1:])
        yield pa.array(changed, pa.large_string())


def _counts(least: int, divisor: int):
    def summed(held):
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for runs in noisy_runs(batch["text"], batch["doc_id"].to_pylist(), least, divisor):
                if len(runs):
                    counted = pc.value_counts(runs)
                    held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
                    size += len(counted)
            if size >= FLUSH:
                merged = summed(held)
                held, size = [merged], merged.num_rows
                if size >= FLUSH // 2:  # mostly new words: pass them on
                    yield from merged.cast(COUNTED).to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).cast(COUNTED).to_batches()
        tidy()
    return run


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, count: int = MIN_COUNT, divisor: int = DIVISOR) -> DataFrame:
    """``(word, n)``: words of at least ``least`` code points and ``count`` occurrences in ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (rows.mapInArrow(_counts(least, divisor), "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= count))


def _lists(words: DataFrame) -> DataFrame:
    """``(side, size, head, fixed, text, word, n)``: list ``(side, size, head)`` compares words of ``size`` and
    ``size + 1`` code points that share ``head``, of which the first ``fixed`` points of ``text`` are part."""
    length = F.length("word")
    sizes = F.array(length, length - 1)
    rows = words.withColumn("size", F.explode(sizes))
    front, back = F.floor(F.col("size") / 2).cast("int"), F.ceil(F.col("size") / 2).cast("int")
    sides = F.array(F.struct(F.lit("f").alias("side"), front.alias("fixed"), F.col("word").alias("text")),
                    F.struct(F.lit("b").alias("side"), back.alias("fixed"), F.reverse("word").alias("text")))
    rows = rows.withColumn("s", F.explode(sides)).select("word", "n", "size", "s.*")
    return rows.withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("fixed")))


def _dealt_again(rows: DataFrame, most: int) -> DataFrame:
    """Lists of more than ``most`` words by a further quarter: behind the shared half a pair shares either the next
    points or, from the end, the last ones."""
    crowded = rows.groupBy("side", "size", "head").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most).drop("many")
    crowded = cut_lineage(crowded)
    if crowded.isEmpty():
        return rows
    keys = ["side", "size", "head"]
    open_ = F.col("size") - F.col("fixed")
    near, far = F.floor(open_ / 2).cast("int"), F.ceil(open_ / 2).cast("int")
    onward = F.struct(F.concat("side", F.lit("n")).alias("side"), (F.col("fixed") + near).alias("fixed"), F.col("text").alias("text"),
                      F.substring(F.col("text"), F.lit(1), F.col("fixed") + near).alias("head"))
    # from the far end: the text is turned, the shared half moves to its end and stays part of the name
    turned = F.struct(F.concat("side", F.lit("t")).alias("side"), far.alias("fixed"), F.reverse("text").alias("text"),
                      F.concat("head", F.lit("|"), F.substring(F.reverse("text"), F.lit(1), far)).alias("head"))
    again = (rows.join(crowded, keys, "left_semi").withColumn("s", F.explode(F.array(onward, turned)))
             .select("word", "n", "size", "s.*"))
    return rows.join(crowded, keys, "left_anti").unionByName(again)


def _matrix(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts of at most ``width`` points, zero behind their end."""
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def near_pairs(code: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)``, i < j, of rows of one group that differ by exactly one edit. ``code`` holds different words as
    code points (zero behind their end), sorted within each group of neighbouring rows."""
    n, width = code.shape
    same = code[1:] == code[:-1]
    lcp = np.full(n + 1, -1, np.int64)  # of a row with the one before it; -1 where a list begins
    lcp[1:n] = np.where(group[1:] == group[:-1], np.where(same.all(1), width, same.argmin(1)), -1)
    jump = np.empty((width + 1, n), np.int32)  # jump[d, p]: the next entry that shares less than d points with p
    for d in range(width + 1):
        breaks = np.flatnonzero(lcp[1:] < d) + 1
        jump[d] = breaks[np.searchsorted(breaks, np.arange(n), side="right")]
    padded = np.concatenate([code, np.zeros((n, 2), code.dtype)], axis=1)
    # The matrix of every word against its present entry: distances to its first d - 1, d and d + 1 points at
    # depth d. At first that entry is the word itself.
    rows = np.ones((n, width + 1, 3), np.int8)
    rows[:, :, 1] = 0
    lane = np.flatnonzero(lcp[1:] >= 0)  # words with an entry behind them
    at = lane + 1
    depth, found = lcp[at], [np.zeros((2, 0), np.int64)]
    while len(lane):
        point, size, deeper = padded[at, depth], length[lane], depth + 1
        a, b, c = rows[lane, depth].T
        low = np.minimum(b + 1, np.where(depth > 0, a + (point != padded[lane, depth - 1]), 9))
        mid = np.minimum(np.minimum(c, low) + 1, b + (point != padded[lane, depth]))
        mid[deeper > size] = 9
        high = np.minimum(mid + 1, c + (point != padded[lane, deeper]))
        high[deeper + 1 > size] = 9
        low[deeper - 1 > size] = 9
        now = np.minimum(np.stack([low, mid, high], axis=1), 9).astype(np.int8)
        live = now.min(axis=1) <= 1
        rows[lane[live], deeper[live]] = now[live]
        whole = live & (deeper == length[at])
        gap = size - deeper
        hit = whole & (np.abs(gap) <= 1)
        hit[hit] = now[hit, gap[hit] + 1] == 1
        found.append(np.stack([lane[hit], at[hit]]))
        # Down this entry, on to the next, or past all that share a prefix without a cell of one edit.
        down = live & ~whole
        at = np.where(down, at, np.where(live, at + 1, jump[deeper, at]))
        depth = np.where(down, deeper, lcp[at])  # entries jumped over share more than that
        go = depth >= 0
        lane, at, depth = lane[go], at[go], depth[go]
    return tuple(np.concatenate(found, axis=1))


def _share(texts: list[str], points: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether texts i and j begin with the same ``points`` code points."""
    if not len(i):
        return np.zeros(0, bool)
    code = _matrix([t[:points] for t in texts], points)
    return (code[i] == code[j]).all(1)


def _neighbours(side: str, size: int, heads: list[str], texts: list[str], words: list[str], n: np.ndarray):
    """Partial ``(word, k, near_n, near)`` of whole lists of one side and size."""
    length = np.array([len(t) for t in texts])
    _, group = np.unique(np.array(heads, dtype=object), return_inverse=True)
    i, j = near_pairs(_matrix(texts, size + 1), length, group)
    mine = np.minimum(length[i], length[j]) == size
    i, j = i[mine], j[mine]
    base = words if side[0] == "f" else [w[::-1] for w in words]
    fixed = size // 2 if side[0] == "f" else -(-size // 2)
    if side[1:] == "t":  # lists of the points behind the shared half come first
        new = ~_share(base, fixed + (size - fixed) // 2, i, j)
        i, j = i[new], j[new]
    if side[0] == "b":  # lists of front halves come first
        new = ~_share(words, size // 2, i, j)
        i, j = i[new], j[new]
    word, near = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, dtype=f"U{size + 1}"), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    k = np.diff(np.append(head, len(word)))
    return pa.RecordBatch.from_arrays([
        pa.array([words[x] for x in word[head]], pa.string()), pa.array(k, pa.int64()), pa.array(n[near[head]], pa.int64()),
        pa.array([words[x] for x in near[head]], pa.string())], ["word", "k", "near_n", "near"])


def _scan(batches):
    """Sorted rows of whole lists; as many lists at a time as fill ``CELLS``, or one."""
    kind, held, cut = None, [], 0  # cut: rows of whole lists among those held

    def settle(rows):
        side, size = kind
        columns = list(zip(*rows))
        return _neighbours(side, size, *map(list, columns[:3]), np.array(columns[3], np.int64))
    for batch in batches:
        for side, size, *row in zip(*(batch[c].to_pylist() for c in ("side", "size", "head", "text", "word", "n"))):
            if (side, size) != kind:
                if held:
                    yield settle(held)
                kind, held, cut = (side, size), [], 0
            elif held[-1][0] != row[0]:
                cut = len(held)
                if cut * (size + 2) > CELLS:
                    yield settle(held)
                    held, cut = [], 0
            held.append(row)
    if held:
        yield settle(held)
    tidy()


def neighbours(words: DataFrame, crowded: int = LIST) -> DataFrame:
    """``(word, n_near, near_n, near)`` of words of ``words(word, n)`` with words one edit away: how many there
    are, and the most frequent of them (of several the first in code-point order)."""
    rows = _dealt_again(_lists(words), crowded)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // 50_000)
    sorted_ = rows.select("side", "size", "head", "text", "word", "n").repartition(parts, "side", "size", "head")
    pairs = sorted_.sortWithinPartitions("side", "size", "head", "text").mapInArrow(_scan, "word string, k long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return pairs.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), "best.near")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``links(word, form)``: where following forms ends. Every round doubles the steps."""
    roots = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                      F.col("further").isNotNull().alias("moved")))
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, least: int = MIN_LENGTH, count: int = MIN_COUNT, ratio: int = RATIO,
                      divisor: int = DIVISOR, crowded: int = LIST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``docs(doc_id, text)``: a word's form is its most
    frequent neighbour, if that occurs ``ratio`` times as often."""
    words = cut_lineage(vocabulary(docs, least, count, divisor))
    near = neighbours(words, crowded)
    known = words.join(near, "word", "left")
    better = F.col("near_n") >= ratio * F.col("n")
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                     F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n")))
    roots = _roots(known.where("form is not null"))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
