"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its distinct word shingles. The shingles have one global order; it is cut into
fragments, every set is cut into one segment per fragment, and each fragment is worked on by itself:

1. *Frequencies.* A fragment counts how many different sets hold each of its shingles. Summed over the
   fragments, a set of n shingles of which more than n - ceil(0.75 n) are its own alone cannot reach the
   threshold with any other set and is settled. Sets that are equal are one class from the start.
2. *Candidates.* In the order (rarest first) two linked sets share one of their first n - ceil(0.75 n) + 1
   shingles. In each such list of sets all are compared with the list's smallest and largest set. The sets
   that this leaves in different components are compared across components, and only those, so a group of
   many near copies never becomes all its pairs.
3. *Counts.* Candidates are dealt to chunks of bounded size. A chunk gets the shared shingles of the sets that
   it names and no others, cut into fragments by their own number, so what moves grows with the candidates and
   not with candidates times fragments of the corpus. Overlaps are counted per chunk and fragment and summed.

The result is exact (up to equal 64-bit hashes): every link either is found or joins sets that are already
known to be in one component. Candidates travel packed, one row for many pairs.

Nulls and empty texts have no shingles and are alone; a text of fewer words than a shingle is one shingle.
Rows that share an id are documents of their own with the same name. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilstream.llm.components import components
from veilstream.llm.words import SPACE, flat, ranges, tidy, word_pieces
from veilstream.session import cut_lineage

FLUSH = 1_500_000        # shingles packed together in a task
FRAGMENT = 2_000_000     # shingles of a fragment on average, however many shuffle partitions there are
COUNTED = 1_000_000      # shingles of a fragment when overlaps are counted
LIST = 50_000            # sets of one list that a task compares
HELD = 1_000_000         # candidates that it holds before it hands them on
ROW = 4_096              # candidates in a row
CHUNK = 2_000_000        # candidates of a chunk on average
SUMS = 16                # groups in which the counts of a chunk are summed, or one for each fragment if it has more
SEGMENT = pa.schema([("fragment", pa.int32()), *((c, pa.binary()) for c in ("cls", "count", "low", "high"))])
_U = np.uint64


def _sets(column: pa.Array, words: int):
    """``(row, sorted distinct shingle hashes)`` of every document."""
    for a, b, found in word_pieces(column, SPACE, lower=True):
        grams, _ = found.grams(words)
        for i in range(b - a):
            first, last = found.first[i], found.first[i + 1]
            if last - first >= words:
                yield a + i, np.unique(grams[first:last - words + 1])
            elif last > first:
                whole = hashlib.blake2b(found.h[first:last].tobytes(), digest_size=8).digest()
                yield a + i, np.frombuffer(whole, np.uint64)
            else:
                yield a + i, np.zeros(0, np.uint64)


def _class(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, cls)``: equal ``cls`` is equal sets; null for an empty set."""
    def run(batches):
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, shingles in _sets(batch["text"], words):
                n[row] = len(shingles)
                cls[row] = _class(shingles) if len(shingles) else None
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(cls, pa.int64())],
                                             ["doc_id", "n_shingles", "cls"])
        tidy()
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_shingles long, cls long"))


def _segments(docs: DataFrame, fragments: int, words: int) -> DataFrame:
    """Segments of many sets packed per fragment; shingles as the low 48 bits in two parts."""
    def packed(cls, sets):
        counts = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), counts)
        fragment = ((h >> _U(32)) * _U(fragments) >> _U(32)).astype(np.uint16 if fragments < 65536 else np.int64)
        order = np.argsort(fragment, kind="stable")
        h, owner, fragment = h[order], owner[order], fragment[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (owner[1:] != owner[:-1])]))
        count = np.diff(np.append(start, len(h))).astype(np.uint32)
        head = np.flatnonzero(np.concatenate([[True], fragment[start][1:] != fragment[start][:-1]]))
        rows = []
        for a, b in zip(head, np.append(head[1:], len(start))):
            i, j = start[a], start[b] if b < len(start) else len(h)
            rows.append((int(fragment[i]), cls[owner[start[a:b]]].tobytes(), count[a:b].tobytes(),
                         h[i:j].astype(np.uint32).tobytes(), (h[i:j] >> _U(32)).astype(np.uint16).tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(SEGMENT.names, row)) for row in rows], SEGMENT)

    def run(batches):
        names, sets, size, seen = [], [], 0, set()
        for batch in batches:
            for _, shingles in _sets(batch["text"], words):
                if len(shingles) and (name := _class(shingles)) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(shingles)
                    size += len(shingles)
                if size >= FLUSH:
                    yield packed(np.array(names), sets)
                    names, sets, size, seen = [], [], 0, set()
        if sets:
            yield packed(np.array(names), sets)
        tidy()
    return docs.select(F.col("text").cast("string")).mapInArrow(
        run, "fragment int, cls binary, count binary, low binary, high binary")


def _read(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _frequencies(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fragment = int(rows["fragment"].iloc[0])
        cls, count = _read(rows["cls"], np.int64), _read(rows["count"], np.uint32).astype(np.int64)
        h = _read(rows["high"], np.uint16).astype(np.int64) << 32 | _read(rows["low"], np.uint32)
        _, first = np.unique(cls, return_index=True)  # equal sets of several tasks are one
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        first = first[np.argsort(cls[first] % buckets, kind="stable")]
        h, cls, count = h[ranges(begin[first], count[first])], cls[first], count[first]
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        times = times[inverse]
        del inverse
        shared = times > 1
        ends = np.cumsum(count)
        n_shared = np.diff(np.concatenate([[0], np.cumsum(shared)[ends - 1]]))
        h, times = (h | fragment << 48)[shared], times[shared]
        bucket, out = cls % buckets, []
        cut = np.concatenate([[0], np.cumsum(n_shared)])
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(edges, np.append(edges[1:], len(bucket))):
            i, j = cut[a], cut[b]
            out.append((int(bucket[a]), cls[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes(),
                        n_shared[a:b].astype(np.uint32).tobytes(), h[i:j].tobytes(),
                        times[i:j].astype(np.uint32).tobytes()))
        tidy()
        return pd.DataFrame(out, columns=["bucket", "cls", "count", "shared", "h", "times"])
    return run


def _survivors(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cls, inverse = np.unique(_read(rows["cls"], np.int64), return_inverse=True)
        count, shared = _read(rows["count"], np.uint32), _read(rows["shared"], np.uint32)
        n = np.bincount(inverse, count, len(cls)).astype(np.int64)
        own = n - np.bincount(inverse, shared, len(cls)).astype(np.int64)
        spare = n - -(-percent * n // 100)
        h, times = _read(rows["h"], np.int64), _read(rows["times"], np.uint32)
        owner = np.repeat(inverse, shared)
        keep = (own <= spare)[owner]
        h, times, owner = h[keep], times[keep], owner[keep]
        order = np.lexsort((h, times, owner))
        h, owner = h[order], owner[order]
        kept = np.flatnonzero((own <= spare) & (own < n))
        begin, end = np.searchsorted(owner, kept), np.searchsorted(owner, kept, side="right")
        return pd.DataFrame({"cls": cls[kept], "n": n[kept], "prefix": (spare - own + 1)[kept],
                             "h": pd.Series([h[a:b] for a, b in zip(begin, end)], dtype=object)})
    return run


def _named(rows: pd.DataFrame) -> pd.DataFrame:
    """``(cls, chunk)``: the sets that the candidates of a chunk name, each once."""
    names = np.unique(np.concatenate([rows["y"].to_numpy(np.int64), _read(rows["cs"], np.int64)]))
    return pd.DataFrame({"cls": names, "chunk": rows["chunk"].iloc[0]})


def _counted(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: a a set of ``pairs(y, n, part, cs, ns, tags)`` and b the tag of a candidate linked with it.
    ``pairs`` is read several times."""
    candidates, rows = pairs.agg(F.sum(F.length("cs")), F.count(F.lit(1))).first()
    chunks = 1 + ((candidates or 0) // 8 + rows) // CHUNK
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("y", "part"), F.lit(chunks)).cast("int"))
    names = cut_lineage(pairs.select("chunk", "y", "cs").groupBy("chunk").applyInPandas(_named, "cls long, chunk int"))
    # one row for each chunk
    pieces = cut_lineage(names.join(sets.select("cls", F.size("h").alias("many")), "cls").groupBy("chunk").agg(
        (1 + F.floor(F.sum("many") / COUNTED)).cast("int").alias("fragments")))

    def pieces_of(rows):
        """Runs of rows of about ``COUNTED`` shingles."""
        ends = np.cumsum(rows["h"].map(len).to_numpy(np.int64))
        edges = np.flatnonzero(np.diff(ends // COUNTED, prepend=0)) if len(rows) else ()
        return [rows.iloc[a:b] for a, b in zip([0, *edges], [*edges, len(rows)]) if a < b]

    def cut(batches):
        for rows in (piece for batch in batches for piece in pieces_of(batch)):
            chunk, many, cls = (rows[c].to_numpy() for c in ("chunk", "fragments", "cls"))
            h, owner = flat(list(rows["h"])).astype(np.int64), np.repeat(np.arange(len(rows)), rows["h"].map(len).to_numpy())
            fragment = (h ^ h >> 24) % many[owner]
            order = np.lexsort((owner, fragment, chunk[owner]))
            h, owner, fragment = h[order], owner[order], fragment[order]
            group = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (chunk[owner][1:] != chunk[owner][:-1])]))
            out = []
            for a, b in zip(group, np.append(group[1:], len(h))) if len(h) else ():
                at, count = np.unique(owner[a:b], return_counts=True)
                out.append((int(chunk[owner[a]]), int(fragment[a]), cls[at].tobytes(), count.astype(np.uint32).tobytes(), h[a:b].tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "fragment", "cls", "count", "h"])

    def overlap(segments: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        cls, count = _read(segments["cls"], np.int64), _read(segments["count"], np.uint32).astype(np.int64)
        _, token = np.unique(_read(segments["h"], np.int64), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        order = np.argsort(cls)
        cls, count, begin = cls[order], count[order], begin[order]
        cls, count, begin = np.append(cls, 0), np.append(count, 0), np.append(begin, 0)  # for sets that are not here
        flags = np.zeros(int(token.max()) + 2 if len(token) else 2, bool)

        def place(names):
            at = np.searchsorted(cls[:-1], names)
            return np.where(cls[at] == names, at, len(cls) - 1)
        out = []
        for y, blob in zip(rows["y"], rows["cs"]):
            mine, others = int(place(np.array([y]))[0]), place(np.frombuffer(blob, np.int64))
            own = token[begin[mine]:begin[mine] + count[mine]]
            flags[own] = True
            sizes = count[others]
            hits = np.concatenate([[0], np.cumsum(flags[token[ranges(begin[others], sizes)]])])
            ends = np.cumsum(sizes)
            out.append((hits[ends] - hits[ends - sizes]).astype(np.int32).tobytes())
            flags[own] = False
        tidy()
        return pd.DataFrame({**{c: rows[c] for c in ("chunk", "y", "n", "part")}, "counts": out, "ns": rows["ns"], "tags": rows["tags"]})

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        total, about, out = {}, {}, []
        for y, n, part, counts, ns, tags in zip(*(rows[c] for c in ("y", "n", "part", "counts", "ns", "tags"))):
            counts = np.frombuffer(counts, np.int32)
            total[y, part] = total[y, part] + counts if (y, part) in total else counts.astype(np.int64)
            if ns is not None:
                about[y, part] = n, np.frombuffer(ns, np.int64), np.frombuffer(tags, np.int64)
        for key, both in total.items():
            n, ns, tags = about[key]
            hit = 100 * both >= percent * (n + ns - both)
            out += [(key[0], int(tag)) for tag in np.unique(tags[hit])]
        return pd.DataFrame(out, columns=["a", "b"])

    placed = sets.select("cls", "h").join(names, "cls").join(F.broadcast(pieces), "chunk")
    segments = placed.select("chunk", "fragments", "cls", "h").mapInPandas(
        cut, "chunk int, fragment int, cls binary, count binary, h binary")
    once = [F.when(F.col("fragment") == 0, F.col(c)).alias(c) for c in ("ns", "tags")]
    spread = pairs.join(F.broadcast(pieces), "chunk").withColumn("fragment", F.explode(F.sequence(F.lit(0), F.col("fragments") - 1)))
    spread = spread.select("chunk", "fragment", "y", "n", "part", "cs", *once)
    counts = segments.groupBy("chunk", "fragment").cogroup(spread.groupBy("chunk", "fragment")).applyInPandas(
        overlap, "chunk int, y long, n long, part int, counts binary, ns binary, tags binary")
    sums = F.pmod(F.hash("y", "part"), F.greatest(F.lit(SUMS), "fragments"))
    return counts.join(F.broadcast(pieces), "chunk").groupBy("chunk", sums).applyInPandas(linked, "a long, b long")


def _across(percent: int):
    """Candidates of the probing sets of each list: sets of larger components, of a length that can link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("key", kind="stable")
        key, cls, n, comp, size, probe = (rows[c].to_numpy() for c in ("key", "cls", "n", "comp", "size", "probe"))
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        found, held = {}, 0

        def flush():
            out = []
            for y, lists in found.items():
                rows_ = np.unique(np.concatenate(lists, axis=1), axis=1)
                out.append((y[0], y[1], rows_[0].tobytes(), rows_[1].tobytes(), rows_[2].tobytes()))
            found.clear()
            return pd.DataFrame(out, columns=["y", "n", "cs", "ns", "tags"])
        for a, b in zip(edges, np.append(edges[1:], len(key))):
            c, m, k, s = (x[a:b] for x in (cls, n, comp, size))
            here = probe[a:b]
            member = np.flatnonzero(here != 2)
            c2, m2, k2, s2 = c[member], m[member], k[member], s[member]
            for i in np.flatnonzero(here):
                ok = ((s2 > s[i]) | (s2 == s[i]) & (k2 > k[i])) & (100 * np.minimum(m2, m[i]) >= percent * np.maximum(m2, m[i]))
                if ok.any():
                    found.setdefault((int(c[i]), int(m[i])), []).append(np.stack([c2[ok], m2[ok], k2[ok]]))
                    held += int(ok.sum())
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()
    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a set that several tasks found, each once, in rows of bounded length."""
    out = []
    for (y, n), group in rows.groupby(["y", "n"], sort=False):
        every = np.stack([_read(group[c], np.int64) for c in ("cs", "ns", "tags")])
        every = every[:, np.unique(every[0], return_index=True)[1]]
        for part, a in enumerate(range(0, every.shape[1], ROW)):
            cs, ns, tags = every[:, a:a + ROW]
            out.append((y, n, part, cs.tobytes(), ns.tobytes(), tags.tobytes()))
    return pd.DataFrame(out, columns=["y", "n", "part", "cs", "ns", "tags"])


PAIRS = "y long, n long, cs binary, ns binary, tags binary"


def class_components(docs: DataFrame, words: int = 5, percent: int = 75, parts: int | None = None) -> DataFrame:
    """``(cls, component)`` of the classes that link with another class; both are class names."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _segments(docs, parts, words).groupBy("fragment").applyInPandas(
        _frequencies(parts), "bucket int, cls binary, count binary, shared binary, h binary, times binary")
    sets = cut_lineage(counted.groupBy("bucket").applyInPandas(
        _survivors(percent), "cls long, n long, prefix long, h array<long>"))
    first = sets.select("cls", "n", F.explode(F.slice("h", F.lit(1), F.col("prefix").cast("int"))).alias("key"))
    lists = first.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("cls", "n")).alias("low"),
                                     F.max(F.struct("cls", "n")).alias("high")).where("many > 1")
    first = cut_lineage(first.join(lists, "key").select("key", "cls", "n", "many", "low", "high"))

    star = (first.select("cls", "n", F.explode(F.array("low", "high")).alias("other")).where("other.cls <> cls")
            .where(100 * F.least("n", "other.n") >= percent * F.greatest("n", "other.n"))
            .select("cls", "n", F.col("other.cls").alias("c"), F.col("other.n").alias("m")).distinct())
    star = (star.groupBy(F.pmod(F.xxhash64("cls"), F.lit(parts)).alias("bucket"))
            .applyInPandas(_packed, PAIRS.replace("n long,", "n long, part int,")))
    linked = cut_lineage(_counted(sets, cut_lineage(star), percent))
    near = components(linked)

    comp = F.coalesce("component", "cls")
    placed = first.join(near.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", "many", comp.alias("comp"))
    sizes = near.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("size"))
    placed = placed.join(sizes, "comp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    several = placed.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"),
                                        F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    placed = placed.join(several.select("key", "top"), "key")
    chunks = F.ceil(F.col("many") / LIST).cast("int")
    chunk = F.pmod(F.xxhash64("cls"), chunks).cast("int")
    probing = F.col("comp") != F.col("top.comp")
    shown = F.transform(F.when(probing, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(chunk)),
                        lambda c: F.struct(c.alias("chunk"), F.when(probing, F.when(c == chunk, 1).otherwise(2)).otherwise(0).alias("probe")))
    placed = placed.withColumn("s", F.explode(shown)).select("key", "cls", "n", "comp", "size", "s.*")
    across = placed.groupBy(F.pmod(F.xxhash64("key", "chunk"), F.lit(parts))).applyInPandas(_across(percent), PAIRS)
    across = across.groupBy(F.pmod(F.xxhash64("y"), F.lit(parts))).applyInPandas(
        _merged, PAIRS.replace("n long,", "n long, part int,"))
    more = _counted(sets, cut_lineage(across), percent)
    more = more.join(near.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("component", "a").alias("a"), "b")
    joined = components(cut_lineage(more))
    every = near.select(F.col("node").alias("cls"), F.col("component").alias("node")).union(
        joined.select("node", "node"))  # a class alone till now is a component of its own
    return (every.distinct().join(joined, "node", "left")
            .groupBy("cls").agg(F.min(F.coalesce("component", "node")).alias("component")))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (y, n), group in rows.groupby(["cls", "n"], sort=False):
        other = group[["c", "m"]].to_numpy(np.int64)
        for part, a in enumerate(range(0, len(other), ROW)):
            cs, ns = other[a:a + ROW, 0].copy(), other[a:a + ROW, 1].copy()
            out.append((y, n, part, cs.tobytes(), ns.tobytes(), cs.tobytes()))
    return pd.DataFrame(out, columns=["y", "n", "part", "cs", "ns", "tags"])


def _components(docs: DataFrame, words: int, percent: int, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """``document_sets`` and ``(cls, low, component_id)``: a class, its smallest doc_id and that of its component."""
    sets = cut_lineage(document_sets(docs, words))
    if parts is None:
        shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + shingles // FRAGMENT)
    linked = class_components(docs, words, percent, parts)
    classes = (sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
               .join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    low = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    return sets, classes.join(low, "component").select("cls", "low", "component_id", "component")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 75, parts: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of ``docs(doc_id, text)``: the smallest id that links lead to."""
    sets, classes = _components(docs, words, percent, parts)
    return (sets.join(classes.select("cls", "component_id"), "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, parts: int | None = None) -> DataFrame:
    """The row with the smallest doc_id of each component, with all columns; of rows that share that id one.
    Rows without shingles all stay."""
    def first_of_class(batches):  # others of a batch cannot be the first of their class
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64()).to_pylist()
            cls, best = [None] * batch.num_rows, {}
            for row, shingles in _sets(batch["text"].cast(pa.string()), words):
                if len(shingles):
                    cls[row] = name = _class(shingles)
                    order = (ids[row] is None, ids[row] or 0, row)
                    best[name] = min(best.get(name, order), order)
            keep = [c is None or best[c][2] == row for row, c in enumerate(cls)]
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], [*batch.schema.names, "__cls"])
            yield batch.filter(pa.array(keep, pa.bool_()))
        tidy()
    _, classes = _components(docs, words, percent, parts)
    lead = (classes.where(F.col("low").eqNullSafe(F.col("component_id"))).groupBy("component")
            .agg(F.min("cls").alias("lead"), F.first("component_id").alias("lead_id")))
    rows = docs.mapInArrow(first_of_class, StructType([*docs.schema.fields, StructField("__cls", LongType())]))
    one = Window.partitionBy("__cls").orderBy("text", *(F.hash(F.col(f"`{c}`")) for c in docs.columns))
    kept = (rows.where("__cls is not null").join(lead, (F.col("__cls") == F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("lead_id")))
            .withColumn("__nth", F.row_number().over(one)).where("__nth = 1"))
    return kept.select(docs.columns).unionByName(rows.where("__cls is null").select(docs.columns))
