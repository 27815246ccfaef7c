"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document is the set of the 64-bit hashes of its word n-grams. Two documents link when the Jaccard similarity of their sets is
at least num/den; ``component_id`` is the smallest id reachable over links.

1. Documents with equal sets form a class; one row per class goes on (aggregated on the map side, so a group of exact
   copies of any size costs one row per task).
2. Two sets that link share one of the first n - ceil(n * num/den) + 1 hashes under any common order of all hashes. The order puts
   n-grams found to be frequent last, by a table of at most ``heavy_limit`` of them (12 bytes each, broadcast); which ones
   are in the table changes the work, never the result.
3. Classes that share such a hash meet in tiles: per hash and size band (a band's sizes differ by less than the ratio, so
   links lie in one band or between neighbours). First each tile is held against its members of smallest and
   largest key, which joins up groups of near copies in linear work; then what is still apart meets pair by pair in blocks
   of at most ``block`` rows, so a large tile is many small tasks.
4. A parity bitmap per class bounds the overlap from above: the bits in which two bitmaps differ are at most the
   size of the symmetric difference. A block gives back, for each class that may link with one of another component, the likeliest
   such partner: rows, not pairs. These partners are intersected exactly, on sorted arrays made from the texts, and join up most of what belongs
   together. The rows that were given back meet again in the same blocks, with bitmaps of ``FINE`` bits a hash. What still may link across
   components then meets with its sorted arrays: all pairs of different components are intersected, and a block gives the links that join
   components, fewer than it has classes.
5. Links become components by alternating large-star and small-star steps, each written to the shared folder. Nodes, hashes and tiles with
   a large share of all rows are joined by a broadcast of these few (at most ``HUBS``), so none fills a task.

No pair between different components is left unexamined, nothing is capped, and no links are collected.
Nulls: a null or empty text, or one without words, has an empty set, no links, and its own id as component; a null id is
smaller than none: the component is the smallest other id, or null. Repeated rows fall in one class. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import buffers, forget, lean, most_frequent, shingles, slices, words, written

LEAST_BITS = 256
BROADCAST_ROWS = 200_000
#: keys that are broadcast as they hold many rows, at most
HUBS = 20_000
#: hashes that a task holds at a time to count frequent ones, and those of one block of a tile
HELD, CELLS = 1 << 21, 1 << 21
#: bits a hash of the second bitmaps
FINE = 8


def sets(batch: pa.RecordBatch, n: int):
    """Row number within the batch's slice, slice and sorted distinct hashes of each row."""
    for part in slices(batch, "text"):
        raw, off = buffers(part.column("text"))
        h, _, _, per = words(raw, off)
        s, at = shingles(h, per, n)
        yield part, [np.unique(s[a:b]) for a, b in zip(at, at[1:], strict=False)]


def digest(hashes: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def bitmap(hashes: np.ndarray, per: int = 1) -> bytes:
    """Parity of the number of hashes at each of 256 or more bits, ``per`` a hash at least: unlike sets then differ in about half of them, far more than linked ones may."""
    bits = LEAST_BITS
    while bits < per * len(hashes):
        bits *= 2
    place = ((hashes >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _matrix(column) -> np.ndarray:
    raw, off = buffers(column)
    return raw.reshape(len(off) - 1, -1)


def differing_bits(a, b) -> np.ndarray:
    """Differing bits of two columns of bitmaps; the longer one is folded, which keeps parity."""
    la, lb = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))  # the product of two lengths needs them
    out = np.zeros(len(la), np.int64)
    for size in np.unique(la * (1 << 20) + lb):
        own = np.flatnonzero(la * (1 << 20) + lb == size)
        x, y = _matrix(a.take(pa.array(own))), _matrix(b.take(pa.array(own)))
        width = min(x.shape[1], y.shape[1])
        x, y = (np.bitwise_xor.reduce(z.reshape(len(own), -1, width), axis=1) if z.shape[1] > width else z for z in (x, y))
        out[own] = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint64)).sum(1)
    return out


def overlap_bound(na, nb, differ):
    """Sets of these sizes whose bitmaps differ in so many bits have no more in common."""
    return np.minimum((na + nb - differ) // 2, np.minimum(na, nb))


def may_link(na, nb, differ, num: int, den: int):
    overlap = overlap_bound(na, nb, differ)
    return den * overlap >= num * (na + nb - overlap)


def beside(rows: DataFrame, side: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, and k, how many of the ``total`` rows have it. Keys of many rows are broadcast."""
    least = max(32, -(-total // HUBS))
    heavy = F.broadcast(side.filter(F.col("k") > least))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(side.filter(F.col("k") <= least), keys)
    return light.unionByName(rows.join(heavy, keys))


def frequent(docs: DataFrame, n: int, heavy_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of a run of rows share, with the sum of their counts: the most frequent ones."""

    def emit(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        h, c = h[c > 2], c[c > 2]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, own in sets(batch, n):
                held += own
                size += sum(map(len, own))
                if size >= HELD:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    table = docs.select("text").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counted = written(table, "frequent")
    table = most_frequent(counted, "c", heavy_limit).toPandas()
    forget(counted)
    h, c = table["h"].to_numpy(np.int64).view(np.uint64), table["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def features(docs: DataFrame, n: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, size, digest of the set, the hashes that stand for it, its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        often, count = shared.value
        for batch in batches:
            for part, own in sets(batch, n):
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                at = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
                common = often[at] == flat if len(often) else np.zeros(len(flat), bool)
                size, d1, d2, prefix, maps, begin = [], [], [], [], [], 0
                for s in own:
                    mark, where = common[begin : begin + len(s)], at[begin : begin + len(s)]
                    begin += len(s)
                    keep = len(s) - -(-len(s) * num // den) + 1 if len(s) else 0
                    first = s[~mark][:keep]
                    if len(first) < keep:
                        rest, c = s[mark], count[where[mark]]
                        first = np.concatenate([first, rest[np.lexsort((rest, c))][: keep - len(first)]])
                    x, y = digest(s)
                    size.append(len(s)), d1.append(x), d2.append(y), prefix.append(first.view(np.int64)), maps.append(bitmap(s))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(maps, pa.binary())], names=["doc_id", "n", "d1", "d2", "prefix", "bits"])

    return docs.mapInArrow(lean(run), f"doc_id {kind}, n int, d1 long, d2 long, prefix array<bigint>, bits binary")


def arrays(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cid and sorted hashes (eight bytes each) of the wanted classes, from the text of one member.

    Up to ``BROADCAST_ROWS`` wanted classes (counted first, 40 bytes each) go to where the texts are; beyond that both sides
    are shuffled by id. A repeated id may give a class twice, which does no harm.
    """
    named = written(classes.join(wanted, "cid", "left_semi").select("cid", "rep", "d1", "d2"), "wanted")
    side = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "cid", "d1", "d2")

    def run(batches):
        for batch in batches:
            for part, own in sets(batch, n):
                d = [digest(s) for s in own]
                same = np.array([x == y for x, y in zip(d, zip(part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([part.column("cid").filter(pa.array(same)), pa.array([s.tobytes() for s, ok in zip(own, same, strict=True) if ok], pa.binary())], names=["cid", "hashes"])

    return texts.mapInArrow(lean(run), "cid long, hashes binary")


def fine_bitmaps(held: DataFrame) -> DataFrame:
    """cid and bits of sorted hashes."""

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column("hashes"))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([bitmap(raw[a:b].view(np.uint64), FINE) for a, b in zip(off, off[1:], strict=False)], pa.binary())], names=["cid", "bits"])

    return held.mapInArrow(lean(run), "cid long, bits binary")


def exact_links(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("ha"), batch.column("hb")
            (rx, ox), (ry, oy) = buffers(x), buffers(y)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = rx[ox[i] : ox[i + 1]].view(np.uint64), ry[oy[i] : oy[i + 1]].view(np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                inter = int((q[at] == p).sum()) if len(q) else 0
                ok[i] = den * inter >= num * (len(p) + len(q) - inter)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = held.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), held.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ha", "hb").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node reachable) for each node of the links but the smallest ones themselves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())  # noqa: E731  # a sum would overflow
    before = sign(edges)
    while before[0]:
        total = 2 * before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = beside(both, least, ["u"], total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = beside(large, low, ["u"], total).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        before_, edges = edges, written(small, name)
        forget(before_, large)
        after = sign(edges)
        if after == before:
            break
        before = after
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out.written_to = edges.written_to
    return out


def _bands(size, num: int, den: int):
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(den / num) * (1 - 1e-9)) + F.lit(1e-9)).cast("int")


def _apart(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with their component so far."""
    if labels is None:
        return rows.withColumn("comp", F.col("cid"))
    return rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _passing(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
                keep = pa.array(may_link(na, nb, differing_bits(batch.column("ba"), batch.column("bb")), num, den))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(lean(run), "a long, b long")


_BLOCK = ("token", "tile", "lo", "hi")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of tiles that hold several components, dealt to the pairs of blocks of their tile: a tile holds a band and the one below it."""
    spread = rows.select("*", F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("own")))).alias("t")).select("token", "cid", "n", "comp", "t.tile", "t.own")
    count = spread.groupBy("token", "tile").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("cells"), F.max("own").alias("any"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("any and c1 < c2")
    count = count.select("token", "tile", "k", F.ceil(F.greatest(F.col("k") / block, F.col("cells") / CELLS)).cast("int").alias("blocks"))
    placed = beside(spread, count, ["token", "tile"], 2 * rows.count()).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "tile", "own", "cid", "n", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")


def _by_block(rows: DataFrame, work, schema: str, spark: SparkSession) -> DataFrame:
    """``work`` on tables of whole blocks, given with the places where a new block begins."""
    ready = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_BLOCK).sortWithinPartitions(*_BLOCK, "cid")

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            key = [t.column(c).to_numpy() for c in _BLOCK]
            edge = np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in key])) + 1 if t.num_rows else np.zeros(0, np.int64)
            if len(edge):
                yield from work(t.slice(0, int(edge[-1])), edge[:-1])
            rest = t.slice(int(edge[-1]) if len(edge) else 0)
        if rest is not None and rest.num_rows:
            yield from work(rest, np.zeros(0, np.int64))

    return ready.mapInArrow(lean(run), schema)


_CANDIDATE = "token long, tile int, lo int, hi int, block int, own boolean, cid long, n int, partner long"


def _candidates(dealt: DataFrame, classes: DataFrame, num: int, den: int, spark: SparkSession) -> DataFrame:
    """The rows of a block that sizes and bitmaps allow to link with one of another component, each with the likeliest such class."""
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]

    def work(t: pa.Table, edge: np.ndarray):
        # rows of all blocks at once are held against those one, two, three ... places further on in their block
        cid, n, comp, own, blk, lo, hi = (t.column(c).to_numpy() for c in ("cid", "n", "comp", "own", "block", "lo", "hi"))
        own, n, across = own.astype(bool), n.astype(np.int64), lo != hi
        bits = t.column("bits").combine_chunks()
        ends = np.append(edge, t.num_rows)
        after = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        active, step = np.arange(t.num_rows), 1
        partner, best = np.full(t.num_rows, -1), np.zeros(t.num_rows)
        while len(active := active[active + step < after[active]]):
            j = active + step
            ok = (comp[j] != comp[active]) & (own[j] | own[active]) & (den * np.minimum(n[j], n[active]) >= num * np.maximum(n[j], n[active])) & (~across[active] | (blk[j] != blk[active]))
            i, j = active[ok], j[ok]
            if len(i):
                overlap = overlap_bound(n[i], n[j], differing_bits(bits.take(pa.array(i)), bits.take(pa.array(j))))
                union = n[i] + n[j] - overlap
                keep = den * overlap >= num * union
                i, j, share = i[keep], j[keep], overlap[keep] / union[keep]
                for x, y in ((i, j), (j, i)):
                    more = share > best[x]
                    best[x[more]], partner[x[more]] = share[more], cid[y[more]]
            step += 1
        found = np.flatnonzero(partner >= 0)
        if len(found):
            part = t.select(names[:-1]).take(pa.array(found)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in part.columns), pa.array(partner[found])], names=names)

    return _by_block(dealt.join(classes.select("cid", "bits"), "cid"), work, _CANDIDATE, spark)


def links_within(hashes: list[np.ndarray], comp: np.ndarray, allowed, num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components of a few sets, as many as join them up; allowed(i): which rows may link with row i."""
    size = np.array([len(h) for h in hashes], np.int64)
    flat, row = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), size)
    _, value = np.unique(flat, return_inverse=True)
    posted = row[np.argsort(value, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(value))])
    begin = np.concatenate([[0], np.cumsum(size)])
    root, out = np.unique(comp, return_inverse=True)[1], []
    for i in range(len(hashes) - 1):
        wanted = allowed(i) & (root != root[i]) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
        wanted[: i + 1] = False
        if not wanted.any():
            continue
        own = value[begin[i] : begin[i + 1]]
        many = upto[own + 1] - upto[own]
        at = np.repeat(upto[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(posted[at], minlength=len(hashes))
        for j in np.flatnonzero(wanted & (den * common >= num * (size + size[i] - common))):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def _several(rows: DataFrame) -> DataFrame:
    """The rows of blocks that hold more than one component."""
    blocks = rows.groupBy(*_BLOCK).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select(*_BLOCK)
    return rows.join(blocks, list(_BLOCK))


def _exact_in_blocks(rows: DataFrame, held: DataFrame, num: int, den: int, spark: SparkSession) -> DataFrame:
    """Links (a, b) of the rows' blocks that join different components."""

    def work(t: pa.Table, edge: np.ndarray):
        for x, y in zip(np.append(0, edge), np.append(edge, t.num_rows), strict=True):
            part = t.slice(int(x), int(y - x))
            cid, comp, own, blk, lo, hi = (part.column(c).to_numpy() for c in ("cid", "comp", "own", "block", "lo", "hi"))
            raw, off = buffers(part.column("hashes"))
            across, own = bool(lo[0] != hi[0]), own.astype(bool)
            found = links_within([raw[p:q].view(np.uint64) for p, q in zip(off, off[1:], strict=False)], comp, lambda i: (own | own[i]) & ((blk != blk[i]) | (not across)), num, den)  # noqa: B023
            if found:
                a, b = (cid[list(z)] for z in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_block(_several(rows).join(held, "cid"), work, "a long, b long", spark)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, heavy_limit: int = 1 << 18, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; links need den * intersection >= num * union."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = written(features(docs, n, num, den, frequent(docs, n, heavy_limit)), "shingles")
    classes = made.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("k"))
    whole = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    full, made = made, written(made.select("doc_id", "n", "d1", "d2"), "documents")
    forget(full)

    classes = whole
    spread = classes.select(F.explode("prefix").alias("token"), "cid", "n")
    shared = spread.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    size = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    rows = written(beside(spread, shared, ["token"], size).select("token", "cid", "n", _bands(F.col("n"), num, den).alias("band")), "tokens")
    classes = written(whole.drop("prefix"), "classes")
    forget(whole)

    ends = rows.groupBy("token", "band").agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("k")).filter("first < last")
    stars = beside(rows, ends, ["token", "band"], size).select("cid", F.explode(F.array("first", "last")).alias("lead")).filter("cid <> lead").select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()
    stars = written(_passing(stars, classes, num, den), "stars")
    nodes = lambda p: p.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    held = written(arrays(docs, classes, nodes(stars), n), "sets")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        links = written(links, "links")
        out = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
        forget(labels, links)
        return out

    # one pair per class first, then only what these have left apart
    labels = components(exact_links(stars.groupBy("b").agg(F.min("a").alias("a")), held, num, den))
    labels = joined(labels, exact_links(apart(stars, labels), held, num, den))
    forget(stars)

    # then all that a tile's bitmaps allow: likeliest partners, and what these leave apart
    found = written(_candidates(_dealt(_apart(rows, labels), block), classes, num, den, spark), "candidates")
    forget(rows)
    others = found.select("cid").distinct().join(held.select("cid"), "cid", "left_anti")
    more = written(arrays(docs, classes, others, n), "sets")
    first, held = held, held.unionByName(more)
    partners = lambda df: df.select(F.least("cid", "partner").alias("a"), F.greatest("cid", "partner").alias("b")).distinct()
    labels = joined(labels, exact_links(partners(found), held, num, den))
    again = _several(_apart(found.drop("partner"), labels))
    wanted = again.select("cid").distinct()
    close = written(_candidates(again, fine_bitmaps(held.join(wanted, "cid", "left_semi")).dropDuplicates(["cid"]), num, den, spark), "candidates")
    forget(found)
    labels = joined(labels, exact_links(partners(close), held, num, den))
    labels = joined(labels, _exact_in_blocks(_apart(close.drop("partner"), labels), held, num, den, spark))
    forget(close, first, more)

    named = classes.select("cid", "d1", "d2", "rep", "k").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("k"))
    result = beside(named.withColumnRenamed("k", "copies"), smallest, ["label"], classes.count()).select("d1", "d2", "component_id", F.col("copies").alias("k"))
    rows = made.filter("n > 0")
    out = beside(rows, result, ["d1", "d2"], rows.count()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = made.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose id is the component of some row with that id: one document of each group."""
    stay = jaccard_components(df, id_col, text_col, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay_id")).distinct()
    return df.join(stay, F.col(id_col).eqNullSafe(F.col("__stay_id")), "left_semi")
