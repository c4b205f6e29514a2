"""Removal of repeated strings with suffix arrays.

Every byte goes that is covered by a string of ``WIDTH`` bytes that also starts anywhere else, in the same or in
another document. All occurrences go, the first one too, and all are judged on the input.

1. *Copies.* Documents are known by the MD5 of their text. What happens to a text depends on the text only, so
   equal texts are worked on once; a text of at least ``WIDTH`` bytes that occurs twice goes as a whole.
2. *Anchors.* The anchor of a string of ``WIDTH`` bytes is the sequence of ``GRAM`` bytes in it with the smallest
   hash, the first of several. Equal strings have equal anchors at the same place. Anchors are counted over all
   documents (combined before the shuffle); a string whose anchor starts in one place only is no repeat, and its
   text is not looked at again.
3. *Shards.* Neighbouring strings with one repeated anchor travel together, packed, to the shard of the anchor,
   where equal strings meet. The number of shards follows from the counted anchors. Where an anchor has always the
   same surroundings all is said; the different surroundings of an anchor, each once, are put into suffix arrays of
   bounded size. These are sorted by Larsson-Sadakane refinement: by eight bytes, and then only the groups that are still equal, by the rank of
   what follows, twice as deep each time, up to ``WIDTH`` bytes. Kasai's common prefixes of neighbours in the
   suffix array say which strings are equal.
4. *Merging.* An anchor that starts in more than ``HEAVY`` places is spread over several shards. These hand on
   their sorted distinct strings as 128-bit fingerprints, cut into ranges, and each range merges the shards'
   sorted runs, two by two, by binary search.

What repeats is put together per text as byte ranges. No group, list or task grows with the number of copies.

Defined cases: null is empty; texts of less than ``WIDTH`` bytes lose nothing. Rows that share a doc_id, or have
none, are documents of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.words import _VALUES, PIECE, mix, pieces, powers, ranges, tidy
from veilstream.session import cut_lineage

WIDTH, GRAM = 400, 200
HEAVY = 4_000            # places of an anchor that stay in one shard
SHARD = 4_000_000        # bytes of a shard on average
SORTED = 3_000_000       # bytes of one suffix array, or one anchor's
FLUSH = 24_000_000       # bytes that a task packs together
MERGED = 1_000_000       # fingerprints of a range on average
LANE = 256
SEEN = 200_000           # texts that a task remembers
OFTEN = 4_096            # an anchor with more than this part of all places is looked up without a shuffle
_U = np.uint64
PACKED = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("keys", "place", "size", "anchor", "spread")),
                    ("bytes", pa.int64()), ("text", pa.binary())])


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    n = len(data)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[:n], out=total[1:])
    return mix((total[gram:] - total[:n - gram + 1]) * inverse[:n - gram + 1])


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """``(starts, anchor of each, hashes)``: the strings of ``width`` bytes that lie in one document, where the
    anchor of each begins, and the hash of the ``gram`` bytes at every position. For at most 2^21 bytes."""
    h = _grams(data, gram)
    have, span = 1, width - gram + 1
    least = h >> _U(21) << _U(21) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first place
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    stop = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(least)) + width <= stop[:len(least)])
    return starts, (least[starts] & _U((1 << 21) - 1)).astype(np.int64), h


def _parts(column: pa.Array, width: int):
    """``(first row, bytes, offsets, place of the first byte in its text)`` of pieces that hold every string of
    ``width`` bytes; long texts come in overlapping parts."""
    for a, _, data, offsets in pieces(column):
        if len(data) <= PIECE + width:
            yield a, data, offsets, 0
            continue
        short = np.flatnonzero(np.diff(offsets))  # a piece that is this long ends with its one long text
        for row in short:
            text = data[offsets[row]:offsets[row + 1]]
            for at in range(0, max(1, len(text) - width + 1), PIECE):
                part = text[at:at + PIECE + width - 1]
                yield a + int(row), part, np.array([0, len(part)]), at


def _sketches(width: int, gram: int):
    """Every text's anchors: their hashes and where they begin. Of equal texts of a task one is enough."""
    def run(batches):
        seen = set()
        for batch in batches:
            keys = batch["key"].to_pylist()
            new = [r for r, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if len(seen) > SEEN:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            hashes, places = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for a, data, offsets, shift in _parts(batch["text"], width):
                if len(data) < width:
                    continue
                _, anchor, h = _anchors(data, offsets, width, gram)
                anchor = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
                row = np.searchsorted(offsets, anchor, side="right") - 1
                edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else ()
                for i, j in zip(edges, np.append(edges[1:], len(row)) if len(row) else ()):
                    hashes[a + row[i]].append(h[anchor[i:j]].view(np.int64))
                    places[a + row[i]].append(anchor[i:j] - offsets[row[i]] + shift)
            keep = [r for r in range(batch.num_rows) if hashes[r]]
            yield pa.RecordBatch.from_arrays([
                batch["key"].take(pa.array(keep, pa.int64())), pa.array([np.concatenate(hashes[r]) for r in keep], pa.list_(pa.int64())),
                pa.array([np.concatenate(places[r]) for r in keep], pa.list_(pa.int64()))], ["key", "hash", "place"])
        tidy()
    return run


def _pack(shards: int, width: int, gram: int, heavy: int):
    """Strings with repeated anchors, packed per shard; ``marks`` names the anchors of a text."""
    def flush(held):
        shard, anchor, spread = (np.array([x[k] for x in held]) for k in (0, 4, 5))
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        for i, j in zip(edges, np.append(edges[1:], len(order))):
            own = order[i:j]
            text = b"".join(held[x][3] for x in own)
            yield {"shard": int(shard[own[0]]), "keys": b"".join(held[x][1] for x in own),
                   "place": np.array([held[x][2] for x in own], np.int64).tobytes(),
                   "size": np.array([len(held[x][3]) for x in own], np.int64).tobytes(), "anchor": anchor[own].tobytes(), "spread": spread[own].astype(np.int8).tobytes(),
                   "bytes": len(text), "text": pa.compress(text, "zstd", asbytes=True)}

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            keys, marks = batch["key"].to_pylist(), batch["marks"]
            rows = [r for r, key in enumerate(keys) if key != (keys[r - 1] if r else last)]  # equal texts are neighbours
            last = keys[-1] if keys else last
            for r in rows:
                key, own = keys[r], marks[r].values
                many = dict(zip(own.field("place").to_pylist(), own.field("n").to_pylist()))
                for _, data, offsets, shift in _parts(batch["text"].slice(r, 1), width):
                    if len(data) < width:
                        continue
                    starts, anchor, h = _anchors(data, offsets, width, gram)
                    raw = data.tobytes()
                    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                    ends = starts[np.append(edges[1:], len(anchor)) - 1]
                    for begin, end, at in zip(starts[edges].tolist(), ends.tolist(), anchor[edges].tolist()):
                        n = many.get(at + shift)
                        if n is not None:
                            among = -(-n // heavy)
                            name = int(h[at]) ^ (int.from_bytes(key[:8], "little") % among * 0x9E3779B97F4A7C15 if among > 1 else 0)
                            name = (name ^ name >> 32) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
                            held.append(((name >> 32) * shards >> 32, key, begin + shift, raw[begin:end + width], h[at], among > 1))
                            size += end + width - begin
                if size >= FLUSH:
                    yield pa.RecordBatch.from_pylist(list(flush(held)), PACKED)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(flush(held)), PACKED)
        tidy()
    return run


def refined(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix array, rank)`` of the bytes by their first ``depth`` bytes (Larsson-Sadakane): equal suffixes have
    equal ranks, the place of the first of them."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for j in range(min(8, depth)):
        first = first << _U(8) | padded[j:j + n]
    order = np.argsort(first)
    first = first[order]
    head = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if n else np.zeros(0, np.int64)
    rank = np.full(n + depth, -1, np.int64)  # behind the end everything is smaller
    count = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, count)
    open_ = np.flatnonzero(np.repeat(count > 1, count))  # places of groups that are not sorted yet
    h = min(8, depth)
    while h < depth and len(open_):
        step = min(h, depth - h)
        suffix = order[open_]
        by = rank[suffix] << 32 | rank[suffix + step] + 1
        sorting = np.argsort(by, kind="stable")
        by, suffix = by[sorting], suffix[sorting]
        order[open_] = suffix
        head = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        count = np.diff(np.append(head, len(by)))
        rank[suffix] = np.repeat(open_[head], count)
        open_ = open_[np.repeat(count > 1, count)]
        h += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, at: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of the suffixes ``at[i]`` (ascending) and ``before[i]``.

    Kasai: where both go on by one byte, all but one byte of the last common prefix is known. Stretches are cut
    into lanes that run side by side."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    data = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (before[1:] != before[:-1] + 1)])
    run = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    lane = np.flatnonzero(place % LANE == 0)
    size = np.diff(np.append(lane, n))
    out, length = np.zeros(n, np.int64), np.zeros(len(lane), np.int64)
    for step in range(int(size.max())):
        live = np.flatnonzero(size > step)
        i = lane[live] + step
        known = np.maximum(length[live] - 1, 0)
        going = np.arange(len(i))
        while len(going):
            k = known[going]
            same = (data[at[i[going]] + k] == data[before[i[going]] + k]) & (k < most)
            going = going[same]
            known[going] += 1
        out[i] = length[live] = known
    return out


def _classes(strings: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """``(string, offset, class, sorted)`` of the ``width`` bytes at every offset of the strings; equal ones are of one
    class, classes are numbered in the order of the suffix array."""
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    _, rank = refined(data, width)
    first = ranges(begin, size - width + 1)
    owner = np.repeat(np.arange(len(size)), size - width + 1)
    sorting = np.argsort(rank[first], kind="stable")  # the suffix array without what is shorter or runs on
    same = rank[first[sorting]][1:] == rank[first[sorting]][:-1]
    before = np.full(len(first), -1, np.int64)
    before[sorting[1:][same]] = first[sorting[:-1][same]]
    having = np.flatnonzero(before >= 0)
    shared = np.zeros(len(first), np.int64)
    shared[having] = common_prefixes(data, first[having], before[having], width)
    cls = np.empty(len(first), np.int64)
    cls[sorting] = np.cumsum(shared[sorting] < width) - 1
    return owner, first - begin[owner], cls


def _shard(width: int):
    def load(rows):
        keys = np.frombuffer(b"".join(rows["keys"]), np.dtype((np.void, 16)))
        names, text = np.unique(keys, return_inverse=True)
        place, anchor = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("place", "anchor"))
        spread = np.frombuffer(b"".join(rows["spread"]), np.int8).astype(bool)
        strings: list[bytes] = []
        for blob, size, sizes in zip(rows["text"], rows["bytes"], rows["size"]):
            raw, at = pa.decompress(blob, size, "zstd", asbytes=True), 0
            for n in np.frombuffer(sizes, np.int64).tolist():
                strings.append(raw[at:at + n])
                at += n
        return names, (text.astype(np.int64) << 40 | place).tolist(), anchor, spread, strings

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, code, anchor, spread, strings = load(rows)
        order = np.argsort(anchor, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        spans, prints, kinds, size = [], [], [], 0  # kinds: of anchors with several different strings, where each begins

        def settle():
            owner, offset, cls = _classes([k[0] for k in kinds], width)
            times = np.bincount(cls, np.array([len(k[1]) for k in kinds])[owner])  # a string stands for all its places
            repeated = times[cls] > 1
            _, one = np.unique(cls, return_index=True)
            wide = np.array([k[2] for k in kinds])
            for w in one[wide[owner[one]]].tolist():
                text, places, _ = kinds[owner[w]]
                at = int(offset[w])
                prints.append((places[0] + at, not repeated[w], hashlib.blake2b(text[at:at + width], digest_size=16).digest()))
            owner, offset = owner[repeated], offset[repeated]
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + width)])) if len(owner) else ()
            for a, b in zip(head, np.append(head[1:], len(owner)) if len(owner) else ()):
                low, high = int(offset[a]), int(offset[b - 1]) + width
                spans.extend((c + low, high - low) for c in kinds[owner[a]][1])
            kinds.clear()
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            own: dict[bytes, set[int]] = {}
            for x in order[a:b].tolist():
                own.setdefault(strings[x], set()).add(code[x])
            wide = bool(spread[order[a]])
            if len(own) == 1 and not wide:  # all places of the anchor look the same
                (text, places), = own.items()
                if len(places) > 1:
                    spans.extend((c, len(text)) for c in places)
                continue
            more = sum(map(len, own))
            if kinds and size + more > SORTED:
                settle()
                size = 0
            kinds.extend((text, sorted(places), wide) for text, places in own.items())
            size += more
        if kinds:
            settle()
        mask = (1 << 40) - 1
        out = pd.DataFrame({"key": [names[c >> 40].tobytes() for c, _ in spans], "start": [c & mask for c, _ in spans],
                            "stop": [(c & mask) + n for c, n in spans], "print": None, "shard": -1})
        if prints:  # one of each kind goes on to be merged with other shards
            out = pd.concat([out, pd.DataFrame({
                "key": [names[c >> 40].tobytes() for c, _, _ in prints], "start": [c & mask for c, _, _ in prints],
                "stop": [-1 if lonely else -2 for _, lonely, _ in prints], "print": [p for _, _, p in prints],
                "shard": int(rows["shard"].iloc[0])})], ignore_index=True)
        tidy()
        return out
    return run


def _merge(width: int):
    """Sorted runs of several shards: strings that two of them have are repeated wherever they start."""
    def merged(a, b):
        """Both runs as one; of strings in both one stays, and all their places are met."""
        at = np.searchsorted(a[0], b[0])
        inside = np.minimum(at, len(a[0]) - 1)
        twin = (a[0][inside] == b[0]) & (len(a[0]) > 0)
        met = np.concatenate([a[1][inside[twin]], b[1][twin]])
        prints, rows = np.insert(a[0], at[~twin], b[0][~twin]), np.insert(a[1], at[~twin], b[1][~twin])
        return (prints, rows), met

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "print"], kind="stable").reset_index(drop=True)
        prints = np.array(rows["print"].tolist(), dtype=object)
        runs = [(prints[i], i) for i in rows.groupby("shard", sort=True).indices.values()]
        repeated = np.zeros(len(rows), bool)
        while len(runs) > 1:
            pairs, left = [], runs[len(runs) // 2 * 2:]
            for a, b in zip(runs[::2], runs[1::2]):
                both, met = merged(a, b)
                repeated[met] = True
                pairs.append(both)
            runs = pairs + left
        found = rows[repeated & (rows["stop"] == -1).to_numpy()]
        return pd.DataFrame({"key": found["key"], "start": found["start"], "stop": found["start"] + width})
    return run


def _marked(anchors: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """``(key, place, n)`` of the ``anchors(key, hash, place)``, ``size`` many, whose hash is in ``repeated(hash, n)``. The
    places of a frequent anchor stay where they are: there are fewer than ``OFTEN`` such anchors, so these are broadcast."""
    often = F.broadcast(repeated.where(F.col("n") * OFTEN > size))
    rest = anchors.join(often, "hash", "left_anti").join(repeated.where(F.col("n") * OFTEN <= size), "hash")
    return anchors.join(often, "hash").unionByName(rest).select("key", "place", "n")


def repeated_ranges(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY, shard: int = SHARD) -> DataFrame:
    """``(key, start, stop)``: byte ranges of the texts of ``texts(key, text)``, key the MD5 of the text, covered by
    strings of ``width`` bytes that start in several places of different texts or of one. Ranges may overlap."""
    if not 8 <= gram <= width:
        raise ValueError("the anchors need at least 8 bytes and at most the width")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = cut_lineage(texts.mapInArrow(_sketches(width, gram), "key binary, hash array<long>, place array<long>"))
    anchors = sketches.select("key", F.explode(F.arrays_zip("hash", "place")).alias("a")).select("key", "a.*")
    places = anchors.select("hash", F.xxhash64("key", "place").alias("code")).groupBy("hash").agg(
        F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(places.where("low <> high").select("hash", "n"))
    size = sketches.agg(F.sum(F.size("hash"))).first()[0] or 0
    marks = cut_lineage(_marked(anchors, repeated, size).groupBy("key").agg(F.collect_set(F.struct("place", "n")).alias("marks")))
    n = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    shards = max(parts, n * (2 * width - gram) // shard)
    strings = texts.join(marks, "key").select("key", "text", "marks").mapInArrow(
        _pack(shards, width, gram, heavy), "shard int, keys binary, place binary, size binary, anchor binary, spread binary, bytes long, text binary")
    found = cut_lineage(strings.groupBy("shard").applyInPandas(
        _shard(width), "key binary, start long, stop long, print binary, shard int"))
    spread = found.where("stop < 0")
    several = max(parts, (spread.count() // MERGED) + 1)
    met = (spread.groupBy(F.pmod(F.xxhash64("print"), F.lit(several))).applyInPandas(_merge(width), "key binary, start long, stop long"))
    return found.where("stop >= 0").select("key", "start", "stop").unionByName(met)


def _kept(width: int):
    def run(batches):
        for batch in batches:
            n, removed, spans, digests, kept = [], [], [], [], []
            for text, copies, found in zip(batch["text"].to_pylist(), batch["copies"].to_pylist(), batch["ranges"].to_pylist()):
                data = (text or "").encode()
                found = [(0, len(data))] if copies > 1 and len(data) >= width else sorted((g["start"], g["stop"]) for g in found or ())
                left, at, count = [], 0, 0
                for start, stop in found:
                    if start > at or not count:
                        left.append(data[at:start])
                        count += 1
                    at = max(at, stop)
                left.append(data[at:])
                rest = b"".join(left)
                n.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def drop_repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, heavy: int = HEAVY, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs(doc_id, text)``: kept are the
    remaining bytes one after the other."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    found = repeated_ranges(rows.select("key", "text"), width, gram, heavy, shard)
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    about = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(found, "key", "left").where("copies > 1 or ranges is not null")
    whole = rows.join(about, "key", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "ranges")
    return whole.mapInArrow(_kept(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
