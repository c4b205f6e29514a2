"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash among the
``gram``-word sequences inside it, so equal windows have equal minimisers, and neighbouring windows mostly
share theirs. A run of consecutive windows with one minimiser is a super-k-mer: it travels as one packed
string to the bucket of its minimiser, where all its windows are cut out again, sorted and compared. Of equal
windows the one that starts first (smaller doc_id, then earlier in the document) stays; every word covered by
another one goes. All windows are judged on the input.

Hot passages: a task sends a super-k-mer once. If the same string occurs again further on in its rows, these
occurrences are settled on the spot, so a bucket gets at most one copy from each ``FLUSH`` of them.

Hot minimisers: windows are counted first, in cells of minimisers. The super-k-mers of a cell with more than
``HEAVY`` windows travel cut into single windows, each to the bucket of its own hash. Cells depend on the words
of a window only, so equal windows still meet. The number of buckets follows from the windows counted.

Defined cases: null, empty and short texts have no windows and keep every word. Every row is a document: of rows
that share a doc_id none starts before the other, so they remove no words of each other, only what smaller ids or
the row itself had before. A null doc_id counts as the smallest. Other columns are ignored. Rows are told apart by
doc_id and text hash; rows equal in both fare alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.words import SPACE, Words, flat, mix, powers, ranges, tidy, word_pieces

FLUSH = 400_000          # super-k-mers packed together in a task
BUCKET = 400_000         # windows of a bucket on average
HEAVY = 1_000_000        # windows of a cell that may stay together
LEAST = -(1 << 63)
PACKED = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("row", pa.binary()), ("start", pa.binary()), ("windows", pa.binary()),
                    ("size", pa.int64()), ("text", pa.binary())])
COUNTS = pa.schema([("cell", pa.int64()), ("windows", pa.int64())])
_U = np.uint64


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (width - have)], h[width - have:]) if width > have else h


def _super_kmers(words: Words, window: int, gram: int):
    """``(first word, number of windows, minimiser, hash of the string)`` of every super-k-mer."""
    n = len(words.h)
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    grams, _ = words.grams(gram)
    least = _smallest(grams[:n - gram + 1], window - gram + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))
    valid = np.flatnonzero(np.arange(window, n + 1) <= last[:n - window + 1])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    least = least[valid]
    head = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    first, count = valid[head], np.diff(np.append(head, len(valid)))
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.h * power[:n], out=total[1:])
    whole = mix((total[first + count + window - 1] - total[first]) * inverse[first] + count.astype(np.uint64))
    return first, count, least[head], whole


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """One of ``parts`` equal ranges of the mixed hash."""
    return ((mix(h.copy()) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _count(cells: int, window: int, gram: int):
    """``(cell, windows)`` of the rows of a task, added up per ``FLUSH`` super-k-mers."""
    def added(held):
        cell, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([x[1] for x in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], schema=COUNTS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, words in word_pieces(batch["text"], SPACE):
                _, count, least, _ = _super_kmers(words, window, gram)
                if len(count):
                    held.append((_part(least, cells), count))
                    size += len(count)
                if size >= FLUSH:
                    yield added(held)
                    held, size = [], 0
        if held:
            yield added(held)
        tidy()
    return run


def heavy_cells(rows: DataFrame, window: int, gram: int, heavy: int) -> tuple[int, np.ndarray, int]:
    """Number of cells, those of more than ``heavy`` windows (at most windows / heavy), and the number of all windows."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(31, max(10, (16 * size // (6 * heavy)).bit_length()))  # a cell holds a small part of ``heavy`` on average
    counts = rows.select("text").mapInArrow(_count(cells, window, gram), "cell long, windows long")
    counts = counts.groupBy("cell").agg(F.sum("windows").alias("windows"))
    found = counts.agg(F.sum("windows").alias("n"), F.collect_list(F.when(F.col("windows") > heavy, F.col("cell"))).alias("heavy")).first()
    return cells, np.array(sorted(found["heavy"]), np.int64), found["n"] or 0


def _firsts(kind: np.ndarray, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For elements sorted by kind, document, row and place: the index of the one that decides about each. That is the
    first of its kind, or for another row of the same document the first of its kind in that row."""
    new = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]) if len(kind) else new
    return np.where(doc == doc[first], np.flatnonzero(own)[np.cumsum(own) - 1], first)


def _pack(buckets: int, window: int, gram: int, cells: int, heavy: np.ndarray):
    def flush(held):
        doc, row, start, count, bucket, whole = (np.concatenate(x) for x in list(zip(*held))[:6])
        text = [s for x in held for s in x[6]]
        order = np.lexsort((start, row, doc, whole))
        earliest = np.empty(len(doc), np.int64)
        earliest[order] = order[_firsts(whole[order], doc[order], row[order])]
        again = [i for i in np.flatnonzero(earliest != np.arange(len(doc))) if text[i] == text[earliest[i]]]
        gone = np.zeros(len(doc), bool)
        gone[again] = True
        settled = np.array([i for i in again if (doc[i], start[i]) != (doc[earliest[i]], start[earliest[i]])], np.int64)
        send = np.flatnonzero(~gone)
        send = send[np.argsort(bucket[send], kind="stable")]
        edges = np.flatnonzero(np.concatenate([[True], bucket[send][1:] != bucket[send][:-1]]))
        for a, b in zip(edges, np.append(edges[1:], len(send))):
            i = send[a:b]
            blob = b" ".join([text[x] for x in i])
            yield {"bucket": int(bucket[i[0]]), "doc": doc[i].tobytes(), "row": row[i].tobytes(), "start": start[i].tobytes(),
                   "windows": count[i].tobytes(), "size": len(blob), "text": pa.compress(blob, "zstd", asbytes=True)}
        if len(settled):  # rows with no text: they are only passed on, neighbours as one
            settled = settled[np.lexsort((start[settled], row[settled], doc[settled]))]
            d, r, s, n = doc[settled], row[settled], start[settled], count[settled]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + n[:-1])]))
            yield {"bucket": -1 - int(d[0] % buckets), "doc": d[head].tobytes(), "row": r[head].tobytes(), "start": s[head].tobytes(),
                   "windows": np.add.reduceat(n, head).tobytes(), "size": 0, "text": b""}

    def cut(words, first, count, whole, least):
        """``(first word, number of windows, bucket, hash of the string)`` of what travels, in parts of bounded length."""
        hot = np.isin(_part(least, cells), heavy) if len(heavy) else np.zeros(len(first), bool)
        cool = ~hot
        yield first[cool], count[cool], _part(least[cool], buckets), whole[cool]
        if hot.any():
            alone = ranges(first[hot], count[hot])
            h = words.grams(window)[0][alone]
            for a in range(0, len(alone), FLUSH):
                part = h[a:a + FLUSH]
                yield alone[a:a + FLUSH], np.ones(len(part), np.int64), _part(part, buckets), part

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, names = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            for a, b, words in word_pieces(batch["text"], SPACE):
                found, windows, least, strings = _super_kmers(words, window, gram)
                raw = words.data.tobytes() if len(found) else b""
                for first, count, bucket, whole in cut(words, found, windows, strings, least) if len(found) else ():
                    if len(first):
                        at = np.searchsorted(words.first, first, side="right") - 1
                        begin, end = words.start[first], words.end[first + count + window - 2]
                        held.append((ids[a:b][at], names[a:b][at], (first - words.first[at]).astype(np.int64), count.astype(np.int64),
                                     bucket, whole, [raw[i:j] for i, j in zip(begin.tolist(), end.tolist())]))
                        size += len(first)
                    if size >= FLUSH:
                        yield pa.RecordBatch.from_pylist(list(flush(held)), PACKED)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(flush(held)), PACKED)
    return run


def _runs(at: np.ndarray, owner: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the stretches in which ``at`` and ``others`` rise by one and ``owner`` stays."""
    same = owner[1:] == owner[:-1]
    for x in (at, *others):
        same = same & (x[1:] == x[:-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    return head, np.append(head[1:], len(at))


def _repeats(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        doc, row, start, count = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("doc", "row", "start", "windows"))
        if rows["bucket"].iloc[0] < 0:
            return pd.DataFrame({"doc": doc, "row": row, "start": start, "stop": start + count + window - 1})
        texts, hashes, begins, ends, kmer = [], [], [], [], 0
        n_words = count + window - 1
        for size, blob, owners in zip(rows["size"], rows["text"], rows["doc"]):
            text = pa.decompress(blob, size, "zstd", asbytes=True)
            found = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), SPACE, False)
            k = len(owners) // 8
            first = np.concatenate([[0], np.cumsum(n_words[kmer:kmer + k])[:-1]]).astype(np.int64)
            grams, _ = found.grams(window)
            hashes.append(grams[ranges(first, count[kmer:kmer + k])])
            begins.append(found.start[first].astype(np.int32))
            texts += [text] * k
            ends.append((first, found.start.astype(np.int32), found.end.astype(np.int32), k))
            kmer += k
        h, begin = flat(hashes), np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        order = np.lexsort((start, row, doc))  # windows by document and place
        owner = np.repeat(order.astype(np.int32), count[order])
        offset = ranges(np.zeros(len(count), np.int64), count[order]).astype(np.int32)
        h = h[begin[owner] + offset]
        place = start[owner] + offset
        sorting = np.argsort(h, kind="stable")
        first = np.empty(len(h), np.int64)
        first[sorting] = sorting[_firsts(h[sorting], doc[owner[sorting]], row[owner[sorting]])]
        again = np.flatnonzero((doc[owner] != doc[owner[first]]) | (place != place[first]))
        lookup = [x for x in ends for _ in range(x[3])]
        base = np.concatenate([np.arange(x[3]) for x in ends]) if ends else np.zeros(0, np.int64)

        def words_of(w: int, length: int) -> list[bytes]:
            o = owner[w]
            firsts, starts, stops, _ = lookup[o]
            i = firsts[base[o]] + offset[w]
            return texts[o][starts[i]:stops[i + length + window - 2]].split()
        if len(again):  # hashes agree: now the words themselves
            good = np.ones(len(again), bool)
            for a, b in zip(*_runs(again, owner[again], first[again], offset[again], offset[first[again]])):
                if words_of(again[a], b - a) != words_of(first[again[a]], b - a):
                    for i in range(a, b):  # unequal windows with one hash: look for the first equal one
                        mine = words_of(again[i], 1)
                        o, p, low = owner[again[i]], place[again[i]], np.searchsorted(h[sorting], h[again[i]])
                        alike = sorting[low:np.searchsorted(h[sorting], h[again[i]], side="right")]
                        alike = alike[(doc[owner[alike]] < doc[o]) | (doc[owner[alike]] == doc[o]) & (row[owner[alike]] == row[o]) & (place[alike] < p)]
                        good[i] = any(words_of(w, 1) == mine for w in alike)
            again = again[good]
        if not len(again):
            return pd.DataFrame({"doc": [], "row": [], "start": [], "stop": []}, dtype=np.int64)
        a, b = _runs(again, owner[again])
        return pd.DataFrame({"doc": doc[owner[again[a]]], "row": row[owner[again[a]]], "start": place[again[a]], "stop": place[again[b - 1]] + window})
    return run


def repeated_passages(docs: DataFrame, window: int = 20, gram: int = 3, buckets: int | None = None,
                      heavy: int = HEAVY) -> DataFrame:
    """``(doc, row, start, stop)``: word ranges of ``docs(doc_id, text)`` covered by windows that start earlier, too.
    Ranges may overlap; doc is the doc_id, the smallest long for null, row the hash of the text. Counts the windows of
    ``docs`` at once."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    cells, hot, windows = heavy_cells(rows, window, gram, heavy)
    buckets = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-windows // BUCKET))
    packed = rows.mapInArrow(_pack(buckets, window, gram, cells, hot), "bucket int, doc binary, row binary, start binary, windows binary, "
                                                           "size long, text binary")
    return packed.groupBy("bucket").applyInPandas(_repeats(window), "doc long, row long, start long, stop long")


def _keep(batches):
    for batch in batches:
        n, removed, digest, texts = [], [], [], []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
            words = (text or "").encode().split()
            n.append(len(words))
            if gone:
                kept, at = [], 0
                for start, stop in sorted((g["start"], g["stop"]) for g in gone):
                    kept += words[at:start] if start > at else []
                    at = max(at, stop)
                words = kept + words[at:]
            removed.append(n[-1] - len(words))
            texts.append(b" ".join(words))
            digest.append(hashlib.sha256(texts[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
             pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def drop_repeated_passages(docs: DataFrame, window: int = 20, gram: int = 3, buckets: int | None = None,
                           heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``: kept are the remaining words with one space between."""
    gone = (repeated_passages(docs, window, gram, buckets, heavy).groupBy("doc", "row")
            .agg(F.collect_list(F.struct("start", "stop")).alias("gone")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(LEAST)), "row": F.xxhash64("text")}).join(gone, ["doc", "row"], "left").drop("doc", "row")
    return rows.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
