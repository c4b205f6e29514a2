"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame functions only).

*Targets.* Sources in code-point order, null last, weigh ``weights`` in turn and share the words of all
documents. No target exceeds ``most`` times its source; what is cut off is shared out again by weight until no
target is above (solved exactly: sources sorted by the share at which they reach the limit, one running sum).

*Blocks.* The documents of a source are cut by hash into about sqrt(documents) blocks, put in random order. A
target of q times the source draws every block floor(q) times, and then blocks in that order until the words
are reached. Only the block in which the target ends is cut, by documents in random order, at the document
boundary nearest to it. So a source misses its target by less than a document.

*Tree.* The drawn blocks are the quota of their source at the root. Each node of the tree halves its output
shards and sends exactly its share of blocks left. Which ones is settled by random keys, one for each block
and level; the number from each source then follows the multivariate hypergeometric distribution, and shards
get disjoint blocks. Inside a shard rows are ordered by another random key.

Planning sees only ids, sources, sizes and text hashes; texts move twice, to their draws and to their shard.
All random keys are MD5 of a seed and names, so reruns agree. Windows are over the sources (one row each), over
drawn blocks (in the order of the square root of the documents) and inside one block of each source.

Defined cases: null, empty and blank texts have size 0 and take no words; a null source is a source. Rows with
one doc_id share their random key and are told apart by size and text, so equal rows are interchangeable.
"""

from __future__ import annotations

from math import ceil, lcm, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.session import cut_lineage

WEIGHTS, MOST, SHARDS, SEED = (5, 2, 1), 3, 8, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def word_count(text) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``(__source, source_size, blocks, target)`` for rows with ``__source`` and ``__size``."""
    wide = "decimal(38,0)"
    sources = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"),
                                           F.ceil(F.sqrt(F.count(F.lit(1)))).alias("blocks"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    common = lcm(*weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    sources = sources.withColumn("weight", weight)
    reach = F.col("source_size").cast(wide) * (F.lit(common) / F.col("weight")).cast("int")
    # sources that reach their limit first come first; before: those already at their limit
    ranked = Window.orderBy("reach", F.col("__source").asc_nulls_last())
    before, rest = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    sources = sources.withColumn("reach", reach).select(
        "*", (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("shares"), F.row_number().over(ranked).alias("rank"))
    free = (F.col("source_size").cast("decimal(20,0)") * F.col("shares").cast("decimal(12,0)") * most
            > F.col("left").cast("decimal(20,0)") * F.col("weight"))
    first = F.min(F.when(free, F.struct("rank", "left", "shares"))).over(every)
    sources = sources.withColumn("first", first)
    target = F.when(F.col("rank") >= F.col("first.rank"), (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.shares"))
    return sources.select("__source", "source_size", "blocks",
                          F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"))


def _shards(draws: DataFrame, shards: int, seed: str) -> DataFrame:
    """Adds ``shard`` to drawn blocks by the splitting tree."""
    draws = draws.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards))
    for level in range(ceil(log2(shards)) if shards > 1 else 0):
        node = Window.partitionBy("low", "high")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        left = F.round(F.count(F.lit(1)).over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        place = F.row_number().over(node.orderBy(_key(seed, "split", level, F.col("name"), F.col("pass")), "name", "pass"))
        goes_left = place <= left
        draws = draws.select("__source", "block", "name", "pass", "partial",
                             F.when(goes_left | (middle == F.col("low")), F.col("low")).otherwise(middle).alias("low"),
                             F.when(goes_left & (middle > F.col("low")), middle).otherwise(F.col("high")).alias("high"))
    return draws.withColumnRenamed("low", "shard").drop("high")


def planned(rows: DataFrame, weights=WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Rows with ``__id``, ``__source``, ``__size`` get ``source_size``, ``target`` and ``draws``: an array of
    ``(pass, shard)``, one for each time that the mix takes the row."""
    sources = source_targets(rows, weights, most)
    rows = rows.join(sources.select(F.col("__source").alias("s"), "source_size", "blocks", "target"),
                     F.col("__source").eqNullSafe(F.col("s")), "left").drop("s")
    number = F.conv(F.substring(_key(seed, "block", F.col("__id").cast("string")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("block", F.pmod(number, F.greatest("blocks", F.lit(1)))).drop("blocks")

    blocks = rows.groupBy("__source", "block", "source_size", "target").agg(F.sum("__size").alias("block_size"))
    name = F.concat_ws(":", F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("n")), F.col("block"))
    blocks = blocks.withColumn("name", name).withColumn("place", _key(seed, "order", F.col("name")))
    order = Window.partitionBy("__source").orderBy("place", "name")
    begin = F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    blocks = blocks.select("__source", "block", "name", "block_size", begin.alias("begin"), passes.alias("passes"),
                           (F.col("target") - passes * F.col("source_size")).alias("rest"))
    whole = F.col("begin") + F.col("block_size") <= F.col("rest")
    partial = ~whole & (F.col("begin") <= F.col("rest"))
    copies = F.col("passes") + F.when(whole | partial, 1).otherwise(0)
    numbers = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: i < F.col("copies"))
    draws = (blocks.withColumn("copies", copies).withColumn("cut", partial)
             .select("__source", "block", "name", F.explode(numbers).alias("pass"), "passes", "cut")
             .select("__source", "block", "name", "pass", (F.col("cut") & (F.col("pass") == F.col("passes"))).alias("partial")))
    drawn = _shards(draws, shards, seed).groupBy("__source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", "partial"))).alias("every"))
    blocks = blocks.join(drawn.select(F.col("__source").alias("s"), F.col("block").alias("b"), "every"),
                         F.col("__source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    blocks = blocks.select(F.col("__source").alias("s"), F.col("block").alias("b"), "begin", "rest", "every",
                           F.exists("every", lambda e: e["partial"]).alias("cut"))

    rows = rows.join(blocks, F.col("__source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    inside = (Window.partitionBy("__source", "block").orderBy(_key(seed, "row", F.col("__id").cast("string")), "__id", "__size", "__tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("begin") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    cut = rows.where("cut").withColumn("in", before + F.col("__size") / 2 <= F.col("rest"))
    rest = rows.where("cut is null or not cut").withColumn("in", F.lit(True))
    taken = F.filter(F.coalesce("every", F.array().cast("array<struct<pass:int,shard:int,partial:boolean>>")),
                     lambda e: F.col("in") | ~e["partial"])
    return (cut.unionByName(rest).withColumn("draws", F.transform(taken, lambda e: F.struct(e["pass"].alias("pass"), e["shard"].alias("shard"))))
            .drop("block", "begin", "rest", "every", "cut", "in"))


def measured(docs: DataFrame) -> DataFrame:
    """Id, source, size and a hash of the text of every row: all that planning needs, so it is written once."""
    return cut_lineage(docs.select(F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"),
                                   word_count("text").alias("__size"), F.xxhash64("text").alias("__tie")))


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: words of the document and those that the mix takes of it."""
    rows = planned(measured(docs), weights, most, shards, seed)
    return rows.select(F.col("__id").cast("long").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
                       (F.col("__size") * F.size("draws")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row for each time that a document is taken: its columns and ``__drawn(pass, shard, place)``, by shard
    and place. Documents without words are never taken."""
    taken = planned(measured(docs), weights, most, shards, seed).where((F.col("__size") > 0) & (F.size("draws") > 0))
    # Equal rows are one group; its n-th row gets the n-th list of draws.
    taken = (taken.groupBy(F.col("__id").alias("i"), F.col("__tie").alias("t"))
             .agg(F.sort_array(F.collect_list("draws")).alias("lists")))
    rows = docs.withColumns({"__id": F.col("doc_id"), "__tie": F.xxhash64("text")})
    rows = rows.join(taken, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__tie") == F.col("t")))
    nth = F.row_number().over(Window.partitionBy("__id", "__tie").orderBy("__tie"))
    rows = rows.withColumn("draws", F.try_element_at("lists", nth)).where(F.size("draws") > 0)
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), "__id", F.explode("draws").alias("draw"))
    place = _key(seed, "place", F.col("draw.shard"), F.col("draw.pass"), F.col("__id").cast("string"))
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns),
                       F.struct("draw.pass", "draw.shard", place.alias("place")).alias("__drawn"))
    return rows.repartitionByRange(F.col("__drawn.shard"), F.col("__drawn.place")).sortWithinPartitions("__drawn.shard", "__drawn.place")
