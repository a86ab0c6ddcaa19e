"""N-gram Jaccard join: an exact self-join of documents on the Jaccard similarity of their word-shingle sets.

Method, by stages (nothing is sampled or capped; every step that drops a pair rests on a bound):

1. Every document becomes its set of 64-bit shingle hashes. Tokens go, packed per text slice, to buckets by hash, where a sort gives each
   token's document frequency. A token in one set only cannot be in an intersection, so a set of which less than the threshold is
   shared has no link and leaves here. What remains is ordered by ascending frequency; only the first
   ``size - ceil(t * size) + 1`` tokens (of those, the shared ones) name the tiles that a set enters, which loses no link.
2. A tile is a token and a size band; bands grow by the threshold's inverse, so that partners are in the same band or in neighbours: a
   set is at home in the tile of its own band and a guest in that of the band above, there only with the first
   ``size - ceil(2 * t * size / (1 + t)) + 1`` tokens, which are enough for the smaller of two sets. In a tile, rows are compared by
   hashed parity bitmaps: the bits in which two bitmaps differ never exceed the symmetric difference, so their count bounds the overlap
   from above. Pairs that pass are intersected exactly, on sorted arrays.
3. First, in rounds, every tile has a pivot (by another hash in each round) and each set is compared with one pivot of another
   component, that of most of its tiles. This joins groups of near copies with comparisons in proportion to their size. Then, in the
   tiles which still hold several components, rows outside the largest are compared with all rows, so no link is lost.
   Equal sets are one node throughout, so copies never meet.

Memory: Python holds one bucket, or the tokens of one slice, at a time; buckets shrink as shuffle partitions grow, slices are bounded.
The largest tiles (the first ``HOT_TILES`` by rows; any other has less than that part of all rows) are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, few, shuffle_partitions, written
from .components import connected_components

BITMAP_WORDS = 8
ROUNDS = 12  # of pivots, at most; what they leave, the comparison within tiles finds
KEY_BYTES = 7  # of a token as sent; its first byte is that of its bucket
HOT_ROWS, HOT_TILES = 500, 1 << 16  # rows of a tile for each task; tiles that are dealt over several
MAX_SLICE = 16 * T.SLICE_BYTES


def _log2_buckets(partitions: int) -> int:
    return max(8, (4 * partitions - 1).bit_length())


def _slice_bytes(log2: int) -> int:
    """Slices grow with the number of buckets, so that what a slice sends to a bucket is worth a row."""
    return min(MAX_SLICE, T.SLICE_BYTES << max(0, log2 - 11))


def _binary(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column of slices of ``data``; offsets count its bytes."""
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [bits, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in one array, and the number of values in each row; nulls have none."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32, len(column) + 1, 4 * column.offset)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw.view(dtype) if size > 1 else raw, np.diff(offsets) // size


def _pack(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def _unpack(raw: np.ndarray) -> np.ndarray:
    """64-bit numbers of packed keys, their first byte 0."""
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = raw.reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


_A = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("tags", pa.binary()), ("sizes", pa.binary()), ("prints", pa.binary()), ("toks", pa.binary()), ("docs", pa.binary())])
_B = pa.schema([*_A, ("df", pa.binary())])
_HEAD = ("ids", "tags", "sizes", "prints")
_SQL_A = "bucket int, batch long, ids binary, tags binary, sizes binary, prints binary, toks binary, docs binary"
_SQL_B = _SQL_A + ", df binary"
_SQL_C = "doc_id long, tag long, size long, p1 long, p2 long, toks binary, ahead long, tiles array<long>, " + ", ".join(f"b{i} long" for i in range(BITMAP_WORDS))


def _emit(shingle: int, log2: int):
    """Documents to packed tokens by bucket; one more row for each slice holds ids, tags, set sizes and 128-bit set prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for number, part in enumerate(T.slices(batches, "text", _slice_bytes(log2))):
            ids, tags = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
            hashes, bounds = T.shingle_sets(*T.buffers(part.column("text")), shingle)
            sizes = np.diff(bounds)
            row = np.repeat(np.arange(len(ids)), sizes)
            sums = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(T.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=sums[0, 1:])
            np.cumsum(T.mix(hashes + np.uint64(0x14057B7EF767814F)), dtype=np.uint64, out=sums[1, 1:])
            prints = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).T.copy()
            _, first = np.unique(np.column_stack([prints, sizes.astype(np.uint64)]), axis=0, return_index=True)
            own = np.zeros(len(ids), bool)
            own[first] = True  # equal sets of a slice send their tokens once
            keep = own[row]
            h, r = hashes[keep], row[keep].astype(np.uint16)
            bucket = (h >> np.uint64(64 - log2)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, r, bucket = h[order], r[order], bucket[order]
            batch = int(T.mix(np.array([place | number], np.uint64)).view(np.int64)[0])
            head = [(int(batch % (1 << log2)), batch, ids.tobytes(), tags.tobytes(), sizes.astype(np.int64).tobytes(), prints.tobytes(), None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*head), _A)], schema=_A)
            if len(h):
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                n = len(edge) - 1
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(np.full(n, batch, np.int64)), none, none, none, none, _binary(_pack(h), edge * KEY_BYTES), _binary(r, edge * 2)], schema=_A)

    return run


def _count_only(shingle: int):
    """Set sizes of rows without an id, which link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            _, bounds = T.shingle_sets(*T.buffers(part.column("text")), shingle)
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, part.column("tag"), pa.array(np.diff(bounds).astype(np.int64)), none], names=["doc_id", "tag", "n_shingles", "component_id"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of each value of ``key`` out of batches that are sorted by it; only one value's rows are held."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and values[lo] != now:
                yield now, held
                held = []
            now = int(values[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of whole buckets, which come sorted, to the shared ones with their document frequency; the slices' own rows pass unchanged."""

    def apart() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).is_valid()
            heads = batch.filter(own)
            if heads.num_rows:
                ready.append(pa.RecordBatch.from_arrays([*heads.columns, pa.nulls(heads.num_rows, pa.binary())], schema=_B))
            yield batch.filter(pa.compute.invert(own)) if heads.num_rows else batch

    ready: list[pa.RecordBatch] = []
    for bucket, rows in _groups(apart(), "bucket"):
        yield from ready
        ready.clear()
        packed, lengths, docs = [], [], []
        for x in rows:
            raw, counts = _flat(x.column(6), np.uint8)
            packed.append(raw)
            lengths.append(counts // KEY_BYTES)
            docs.append(_flat(x.column(7), np.uint16)[0])
        raw, length, doc = np.concatenate(packed), np.concatenate(lengths), np.concatenate(docs)
        batch = np.concatenate([x.column(1).to_numpy() for x in rows])
        del packed, docs, rows
        toks = _unpack(raw)
        order = np.argsort(toks)
        ordered = toks[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        df = np.empty(len(toks), np.uint16)
        df[order] = np.repeat(np.minimum(np.diff(edge), 65535), np.diff(edge))
        del toks, order, ordered, edge
        shared = df > 1
        ends = np.cumsum(length)
        left = np.concatenate([[0], np.cumsum(shared)])
        n = left[ends] - left[ends - length]
        has = np.flatnonzero(n > 0)
        raw, doc, df = raw.reshape(-1, KEY_BYTES)[shared], doc[shared], df[shared]
        at = np.concatenate([[0], np.cumsum(n[has])])
        for lo in range(0, len(has), 1 << 14):  # rows of a batch
            own, edges = has[lo : lo + (1 << 14)], at[lo : lo + (1 << 14) + 1]
            cut_ = slice(edges[0], edges[-1])
            none = pa.nulls(len(own), pa.binary())
            edges = edges - edges[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket, np.int32)), pa.array(batch[own]), none, none, none, none, _binary(raw[cut_], edges * KEY_BYTES), _binary(doc[cut_], edges * 2), _binary(df[cut_], edges * 2)], schema=_B)
    yield from ready
    T.release()


def _nodes(num: int, den: int, log2: int):
    """Shared tokens of whole slices, which come sorted, to one row per document; rows that can have a link also get tokens, tiles and
    bitmap."""

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs, keys, dfs, head = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], None
        for x in rows:
            raw, counts = _flat(x.column(6), np.uint8)
            bucket = np.repeat(x.column(0).to_numpy().astype(np.uint64), counts // KEY_BYTES)
            keys.append(_unpack(raw) | ((bucket >> np.uint64(log2 - 8)) << np.uint64(56)))
            docs.append(_flat(x.column(7), np.uint16)[0].astype(np.int64))
            dfs.append(_flat(x.column(8), np.uint16)[0])
            own = x.column(2).is_valid()
            if pa.compute.any(own).as_py():
                head = x.filter(own).to_pylist()[0]
        ids, tags, sizes = (np.frombuffer(head[c], np.int64) for c in ("ids", "tags", "sizes"))
        prints = np.frombuffer(head["prints"], np.int64).reshape(-1, 2)
        n = len(ids)
        doc, key, df = np.concatenate(docs), np.concatenate(keys), np.concatenate(dfs)
        shared = np.bincount(doc, minlength=n)
        able = (shared * den >= num * sizes) & (sizes > 0) & (shared > 0)
        keep = able[doc]
        doc, key, df = doc[keep], key[keep], df[keep]
        by_key = np.lexsort((key, doc))
        doc, key, df = doc[by_key], key[by_key], df[by_key]
        bounds = np.searchsorted(doc, np.arange(n + 1))
        mixed = T.mix(key)
        bit = (mixed & np.uint64(63), ((mixed >> np.uint64(6)) % np.uint64(BITMAP_WORDS)).astype(np.int64))
        bits = np.zeros((n, BITMAP_WORDS), np.uint64)
        np.bitwise_xor.at(bits, (doc, bit[1]), np.uint64(1) << bit[0])
        prefix = np.maximum(0, sizes - (-(-num * sizes // den)) + 1 - (sizes - shared))
        by_df = np.lexsort((key, df, doc))
        first = (np.arange(len(doc)) - bounds[doc]) < prefix[doc]  # docs stand in the same places in both orders
        tiles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=n))]).astype(np.int32)), pa.array(key[by_df][first].view(np.int64)))
        toks = _binary(key.astype("<u8").view(np.uint8), bounds * 8, able)
        columns = [pa.array(ids), pa.array(tags), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), toks, pa.array(sizes - shared), tiles]
        return pa.RecordBatch.from_arrays(columns + [pa.array(bits[:, i].view(np.int64)) for i in range(BITMAP_WORDS)], names=["doc_id", "tag", "size", "p1", "p2", "toks", "ahead", "tiles", *(f"b{i}" for i in range(BITMAP_WORDS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "batch"):
            yield one(rows)
        T.release()

    return run


def _intersect(num: int, den: int):
    """Pairs with both token arrays to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), batch.column("na").to_pylist(), batch.column("nb").to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(den * both >= num * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], names=["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fits(num: int, den: int, left: str, right: str):
    """Size band and bitmap bound of a pair whose columns have these prefixes: what neither refutes stays."""
    n, m = F.col(f"{left}size"), F.col(f"{right}size")
    differ = sum((F.bit_count(F.col(f"{left}b{i}").bitwiseXOR(F.col(f"{right}b{i}"))) for i in range(BITMAP_WORDS)), F.lit(0))
    # |x ^ y| >= differ, so |x & y| <= (n + m - differ) / 2 and |x | y| >= (n + m + differ) / 2
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (den * (n + m - differ) >= num * (n + m + differ))


def _prefixed(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(prefix + c) for c in columns))


def ngram_jaccard_join(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Two documents link when ``den * |x & y| >= num * |x | y|``; component_id is the smallest doc_id that links reach. Texts, whole
    however long, are lower-cased A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``shingle`` words is one
    shingle; null, empty and blank texts have the empty set, n_shingles 0, and are linked with nothing. Equal sets always link. Rows with
    the same doc_id stay separate rows of one id; rows without one link with nothing and have a null component. Other columns of ``docs``
    are ignored. An empty table gives an empty result. ``docs`` must give its rows in the same order when a task runs again (a scan of
    files does).
    """
    return linked_rows(docs, shingle, num, den).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``ngram_jaccard_join`` with ``tag``, xxhash64 of the text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    log2 = _log2_buckets(partitions)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    nameless = texts.filter("doc_id is null").select("tag", "text").mapInArrow(_count_only(shingle), "doc_id long, tag long, n_shingles long, component_id long")
    sent = texts.filter("doc_id is not null").mapInArrow(_emit(shingle, log2), _SQL_A)
    shared = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequencies, _SQL_B)
    rows = written(shared.repartition(partitions, "batch").sortWithinPartitions("batch").mapInArrow(_nodes(num, den, log2), _SQL_C))

    bits = [f"b{i}" for i in range(BITMAP_WORDS)]
    sets = rows.filter("size > 0").groupBy("p1", "p2", "size").agg(F.min("doc_id").alias("node"))
    # a slice's first row of a set has its tokens, and the smallest of a set's able rows speaks for it
    able = rows.filter("toks is not null").groupBy("p1", "p2", "size").agg(F.min_by(F.struct("toks", "ahead", "tiles", *bits), "doc_id").alias("x"))
    nodes = written(able.join(sets, ["p1", "p2", "size"]).select("node", "size", "x.*"))
    enough_links = max(100, nodes.count() // 100)

    def verified(full: DataFrame) -> DataFrame:
        """(ca, cb) of the pairs that link."""
        return full.select("ca", "cb", F.col("a_size").alias("na"), F.col("b_size").alias("nb"), F.col("a_toks").alias("ta"), F.col("b_toks").alias("tb")).mapInArrow(_intersect(num, den), "ca long, cb long").distinct()

    def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels of all nodes after ``links(ca, cb)`` between components."""
        joined = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return cut(few(labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))))

    def shown(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows of the tiles that hold several components, with the largest of these, and with a salt: the largest tiles are dealt over
        several tasks, others over one. Without labels every node is a component."""
        if labels is None:
            marked = tiles.withColumn("comp", F.col("node"))
            parts = marked.groupBy("tile").agg(F.count("*").alias("n"), F.max("comp").alias("most")).withColumn("parts", F.col("n"))
        else:
            marked = tiles.join(labels, "node")
            parts = marked.groupBy("tile", "comp").agg(F.count("*").alias("n")).groupBy("tile").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count("*").alias("parts"))
        mixed = cut(few(parts.filter("parts > 1").select("tile", "most", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))))
        hot = mixed.filter("salts > 1").orderBy(F.desc("salts"), "tile").limit(HOT_TILES).select("tile", F.col("salts").alias("hot"))
        dealt = marked.join(F.broadcast(hot), "tile", "left")  # at most HOT_TILES rows
        dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("hot")), F.lit(0)).cast("int")).drop("hot")
        return written(few(dealt.join(copied(mixed), ["tile", "salt"])))

    def copied(rows: DataFrame) -> DataFrame:
        """Rows once for each salt of their tile."""
        return rows.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    labels = nodes.select("node", F.col("node").alias("comp"))
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num))).cast("int")
    tiles = nodes.select("node", "size", "ahead", band.alias("band"), F.posexplode("tiles").alias("pos", "token")).withColumn("at", (F.col("ahead") + F.col("pos")).cast("int"))
    smaller = F.col("at") <= F.col("size") - F.ceil(2 * num * F.col("size") / (num + den))  # reaches for the smaller of two sets
    place = lambda up, guest: F.struct(F.xxhash64("token", F.col("band") + up).alias("tile"), F.lit(guest).alias("guest"))
    tiles = tiles.select("node", F.col("size").cast("int").alias("size"), "at", F.inline(F.when(smaller, F.array(place(0, False), place(1, True))).otherwise(F.array(place(0, False)))))
    for round_ in range(ROUNDS):
        rows_ = shown(tiles, labels if round_ else None)
        tiles = rows_.select("node", "size", "at", "tile", "guest")
        order = F.xxhash64(F.lit(round_), "node") if round_ else F.col("node")
        pivot = rows_.groupBy("tile").agg(F.min_by(F.struct("node", "comp", "size"), order).alias("p"), F.first("salts").alias("salts"))
        near = rows_.join(copied(pivot).drop("salts"), ["tile", "salt"]).filter((F.col("p.comp") != F.col("comp")) & (den * F.least("size", "p.size") >= num * F.greatest("size", "p.size")))
        near = near.groupBy("node", "comp", F.col("p.node").alias("b"), F.col("p.comp").alias("cb")).agg(F.count("*").alias("n"))
        near = near.groupBy(F.col("node").alias("a"), F.col("comp").alias("ca")).agg(F.max_by(F.struct("b", "cb"), F.struct("n", "b")).alias("x")).select("a", "ca", "x.b", "x.cb")
        near = near.join(_prefixed(nodes, "a_", "node", "size", "toks", *bits), F.col("a") == F.col("a_node")).join(_prefixed(nodes, "b_", "node", "size", "toks", *bits), F.col("b") == F.col("b_node")).filter(_fits(num, den, "a_", "b_"))
        links = cut(few(verified(near)))
        found = links.count()
        if found:
            labels = relabel(labels, links)
        if found <= enough_links:
            break

    last = shown(tiles, labels).join(_prefixed(nodes, "", "node", *bits), "node")
    columns = ("node", "size", "at", "comp", "tile", "guest", "most", "salt", *bits)
    left, right = _prefixed(last, "a_", *columns), _prefixed(copied(last), "b_", *columns)
    # pairs of two rows outside the tile's largest component come once, in the order of their nodes; two guests meet at home; a pair
    # need be seen in its first common tile only, so what is left of both sets after this one must still make the overlap
    once = ((F.col("b_comp") == F.col("b_most")) | (F.col("a_node") < F.col("b_node"))) & ~(F.col("a_guest") & F.col("b_guest"))
    enough = lambda x: (num + den) * (F.col(f"{x}size") - F.col(f"{x}at")) >= num * (F.col("a_size") + F.col("b_size"))
    across = left.filter("a_comp <> a_most").join(right, (F.col("a_tile") == F.col("b_tile")) & (F.col("a_salt") == F.col("b_salt")) & (F.col("a_comp") != F.col("b_comp")) & once & enough("a_") & enough("b_") & _fits(num, den, "a_", "b_"))
    pairs = across.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_comp").alias("ca"), F.col("b_comp").alias("cb")).distinct()
    pairs = pairs.join(_prefixed(nodes, "a_", "node", "size", "toks"), F.col("a") == F.col("a_node")).join(_prefixed(nodes, "b_", "node", "size", "toks"), F.col("b") == F.col("b_node"))
    named = relabel(labels, cut(few(verified(pairs)))).select("node", F.col("comp").alias("component_id"))
    # what is neither in an equal set of several documents nor a node with links is a component of its own
    known = sets.join(named, "node", "left").select("p1", "p2", "size", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.join(known, ["p1", "p2", "size"], "left").select("doc_id", "tag", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(nameless)
