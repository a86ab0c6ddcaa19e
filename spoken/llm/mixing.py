"""Mixing sources to target weights.

Documents are packed, source by source, into blocks of ``block`` words. The mix is a number of output shards of ``slots`` block slots
each. Every shard draws a multinomial count for each source from its own seed; counts beyond a source's quota are reassigned to
sources that fell short, so that a source's slots come to its quota. A source's slots are numbered through the shards, slot j takes
block ``perm_e(j mod n)`` of round e = j div n, where ``perm_e`` is a keyed pseudorandom permutation of 0..n-1, and slots are joined
with blocks by (source, index); a shard's slots are dealt to its sources by another such permutation. A block is thus taken either floor or ceil of its share of the source's slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK, SLOTS = 32, 4096
MAX_SHARDS, MAX_SOURCES = 2000, 5000  # the plan, a count for each shard and source, is made on the driver
ROUNDS = 4


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Words wanted of each source: by code point, null last, repeating weights share all words; what a target exceeds ``cap`` times
    its source is shared again among the rest by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    free = [s for s in names if sizes[s]]
    out = {s: 0.0 for s in names}
    while free:
        left = total - sum(out[s] for s in names if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
        free = [s for s in free if s not in over]
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1, elementwise: a four-round Feistel network on the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out, todo = index.astype(np.uint64), index.astype(np.uint64), np.arange(len(index))

    def mix(v):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = (left << h) | right
        inside = x[todo] < n[todo].astype(np.uint64)
        out[todo[inside]] = x[todo[inside]]
        todo = todo[~inside]
    return out.astype(np.int64)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _plan(shards: int, slots: int, quotas: list[int], seed: int) -> np.ndarray:
    """Slots of each source by shard. Draws are multinomial by shard; the running sum of a source stops at its quota, and slots freed
    by that go to sources short of theirs."""
    want, left = np.array(quotas, np.int64), np.array(quotas, np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)
    for s in range(shards):
        n = min(slots, int(left.sum()))
        drawn = np.minimum(np.random.default_rng([seed, s]).multinomial(n, want / want.sum()), left)
        short = left - drawn
        missing = n - int(drawn.sum())
        if missing:  # by what is left of each source, remainders to the largest
            extra = short * missing // short.sum()
            rest = missing - int(extra.sum())
            extra[np.argsort(-(short - extra), kind="stable")[:rest]] += 1
            drawn = drawn + np.minimum(extra, short)
        out[s], left = drawn, left - drawn
    if left.any():
        out[-1] += left
    return out


def _mix(docs: DataFrame, block: int, slots: int, seed: int, weights: tuple, cap: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its place among its source's words, and the filled slots with their blocks' pieces."""
    spark = docs.sparkSession
    # rows are packed in the order of a hash; parts are ranges of it, so their number changes where work is done, not the order
    bits = min(20, max(6, (4 * shuffle_partitions(spark) - 1).bit_length()))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text").alias("at"))
    sized = cut(sized.withColumn("part", F.shiftright("at", 64 - bits).cast("int")))

    # where a source's words stand: sums of (source, part), then sums within each; no task ever holds a source
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("source", "part", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, placed.source.eqNullSafe(base.source) & (placed.part == base.part)).select("doc_id", placed.source, "size", "at", (F.col("before") + F.col("base")).alias("start"))

    sizes = {r["source"]: int(r["words"] or 0) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"{len(sizes)} sources; a mix is planned for at most {MAX_SOURCES}")
    wanted = targets(sizes, weights, cap)
    names = [s for s in wanted if wanted[s] > 0]
    blocks = {s: -(-sizes[s] // block) for s in names}
    quotas = [min(cap * blocks[s], round(wanted[s] * blocks[s] / sizes[s])) for s in names]
    slots = max(slots, -(-sum(quotas) // MAX_SHARDS))
    shards = max(1, -(-sum(quotas) // slots))
    plan = _plan(shards, slots, quotas, seed) if names else np.zeros((1, 0), np.int64)
    starts, offsets, lengths = np.cumsum(plan, axis=0) - plan, np.cumsum(plan, axis=1) - plan, plan.sum(axis=1)
    rows = [(i, k, int(starts[i, k]), int(plan[i, k]), blocks[names[k]], int(offsets[i, k]), int(lengths[i])) for i in range(shards) for k in range(len(names)) if plan[i, k]]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, k, start, count, n, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(start, start + count, 1 << 18):
                    j = np.arange(at, min(at + (1 << 18), start + count), dtype=np.int64)
                    key = (j // n + 1) * 1_000_003 + k * 7919 + seed
                    index = permute(j % n, np.full(len(j), n, np.int64), key)
                    slot = permute(j - start + offset, np.full(len(j), length, np.int64), np.full(len(j), shard * 104_729 + seed, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard, np.int64)), pa.array(slot), pa.array(np.full(len(j), k, np.int64)), pa.array(index)], names=["shard", "slot", "k", "block"])

    schema = "shard long, k long, start long, count long, n long, offset long, length long"
    filled = spark.createDataFrame(rows, schema).repartition(shuffle_partitions(spark)).mapInArrow(fill, "shard long, slot long, k long, block long")
    facts = spark.createDataFrame([(s, sizes[s], float(wanted[s]), names.index(s) if s in names else -1) for s in wanted], "source string, source_size long, target double, k long")
    facts = F.broadcast(facts)  # one row a source
    placed = placed.join(facts, placed.source.eqNullSafe(facts.source)).drop("source")
    # a document's words lie in blocks start/block .. (start+size-1)/block
    spans = placed.filter("size > 0").select("doc_id", "at", "k", "start", "size", F.posexplode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("i", "block"))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).cast("long")
    last = (F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")) - 1).cast("long")
    # a block has at most ``block`` pieces; they stand in it in the order of their start
    packed = spans.groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", first.alias("first"), last.alias("last")))).alias("pieces"))
    sources = F.broadcast(facts.select("k", "source"))
    return placed, filled.join(packed, ["k", "block"]).join(sources, "k")


def mix_blocks(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 17, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(shard, slot, source, block, pieces): the mix of ``docs(doc_id, text, source)``, a row for each slot, numbered from 0.

    ``pieces`` are the block's parts in order: (start, doc_id, first, last), the first and last of the document's words, from 0, that
    the block takes, and where the document's row stands among the words of its source, which tells repeated rows apart.
    """
    return _mix(docs, block, slots, seed, weights, cap)[1].select("shard", "slot", "source", "block", "pieces")


def mix_sources(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 17, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``; taken is summed over ``mix_blocks``.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0) of the whole text, however long. A source's last block may be
    shorter. A row without words takes none; a source without words has target 0; rows without a source are a source of their own.
    Repeated rows are rows of their own, and an empty table gives an empty result; other columns are ignored. Rows are packed in the
    order of a hash of doc_id and text (ties by doc_id and size, beyond which rows are the same), whatever the number of partitions, so
    reruns agree on any cluster. The driver sees one row a source; more than ``MAX_SOURCES`` are an error.
    """
    placed, mixed = _mix(docs, block, slots, seed, weights, cap)
    used = mixed.select("k", F.inline("pieces")).groupBy("k", "start").agg(F.sum(F.col("last") - F.col("first") + 1).alias("taken"))
    out = placed.join(used, (placed.k == used.k) & (placed.start == used.start) & (placed["size"] > 0), "left")
    return out.select(placed.doc_id, placed["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
