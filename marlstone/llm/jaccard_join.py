"""N-gram Jaccard join in the metric space of word-shingle sets.

Metric. Sets are compared by the shingles that they differ in; at similarity num/den a linked pair of a and b
shingles differs in ``allowed(a + b)`` at most, so the Jaccard threshold is a radius. A parity sketch maps
sets into bit strings whose Hamming distance never exceeds that of the sets: a radius and a window that
hold for sketches lose no pair, and distances to pivots cost a few words instead of whole sets.

First regions. Unrelated sets are equally far from every pivot, so pivots over a whole corpus prune nothing:
every window holds everything (README has the figures). Sets fall into bands of size first, sets at an edge
into two, and a band's shingle universe into more parts than a linked pair can differ in. Linked sets agree
in a known number of parts, so a set that shares fewer of its parts with any other is out, and of the
others only the rarest parts, as many as that number leaves necessary, are regions. Regions with the same
members are one.

Pivots. A region's pivot is the member that is in most regions; members within the radius link to it. A
region whose other members are not all connected goes on: where it is large, several pivots cut it into
Voronoi cells, each member goes to its nearest pivot and, as a copy, to every pivot that the triangle
inequality leaves possible, its own distance plus two radii; cells are cut again until they are small. Where
that would spare less than half of the pairs, as all members are about as far from each other, no row is
copied and the members are compared in blocks. In a cell the nearest pairs of different components are verified by their whole
sets first, and more pairs in each round, until none is left that could link. All of this is exact.

On tables of texts no cell is cut: of check_h, check_l and the sf tables not one region is above ``CELL``, as parts and
their count leave groups of near copies, and those of the largest (1,861) are about equally far from each other. There
links come from parts and from each region's pivot; cells and windows run where a region is large and spread out. A very
long text is one set of its distinct shingles' hashes, 8 bytes each, held by one task.

Nulls and texts without words have an empty set and link with nothing. Texts with fewer words than a
shingle are one shingle. Repeated rows are copies, and rows that share an id documents of their own. A null
id takes no part and gets a null component unless its text has other copies. Exact copies of a set (told
apart by a 64-bit hash) take part once. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, components, sorted_groups
from .tokens import slices

#: Size classes taken together in a band, for sets of ``SMALL`` shingles and more.
CLASSES = 4
SMALL = 64
#: Parts of the key space that are shuffled one after another, so that all keys are never on disk at once.
BATCHES = 4
#: Members of a region that one task compares at once; larger regions are cut.
CELL = 256
#: Pivots that cut a large region, and members of a block where pivots would not spare half of its pairs.
PIVOTS = 8
BLOCK = 2048
#: Sets whose keys a task remembers, so that it gives those of a repeated set once.
REMEMBERED = 50_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z lower-cased."""
    import xxhash

    words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if not distinct:
        return [np.zeros(0, np.uint64)] * len(texts)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in distinct), np.uint64, len(distinct))
    real = np.fromiter((w != "" for w in distinct), bool, len(distinct))[codes]
    doc = np.repeat(np.arange(len(counts)), counts)[real]
    h = known[codes[real]]
    counts = np.bincount(doc, minlength=len(counts))
    ends = np.cumsum(counts)
    grams = np.zeros(len(h), np.uint64)
    for i in range(width):
        grams[: len(h) - i] = grams[: len(h) - i] * _A + h[i:]
    grams = _mix(grams * _B)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            out.append(np.unique(grams[end - n : end - width + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for x in h[end - n : end]:
                whole = whole * _A + x
            out.append(_mix(whole * _C))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def allowed(total: int, num: int, den: int) -> int:
    """Most shingles that two sets of ``total`` shingles together can differ in at similarity num/den."""
    return (den - num) * total // (den + num)


@lru_cache
def size_bands(num: int, den: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Lower ends of bands of set sizes, and for each: end of the sizes it shares with the band before, end
    of all its sizes (with those shared with the next), parts.

    Sizes in a class differ by a factor of num/den at most, so a linked pair is in the same or in neighbouring
    classes. A band is one class where sets are small and ``CLASSES`` of them above; the first class of a band
    belongs to the band before too.
    """
    ends = [-(-num // (den - num))]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * den // num)))
    firsts, k = [], 0
    while k + CLASSES + 1 < len(ends):
        firsts.append(k)
        k += 1 if ends[k] < SMALL else CLASSES
    lows = [ends[k] for k in firsts]
    out = []
    for k, after in zip(firsts, firsts[1:]):
        high = ends[after + 1]
        parts = allowed(2 * (high - 1), num, den) + 1
        if ends[k] < 4 * SMALL:
            parts = max(parts + 6, 5 * (den - num) * ends[k] // (2 * den))
        out.append((ends[k + 1], high, parts))
    return lows, out


@lru_cache(maxsize=4096)
def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, parts) for each band that a set of ``n`` shingles belongs to."""
    lows, all_bands = size_bands(num, den)
    if n < lows[0]:
        return []
    own = int(np.searchsorted(lows, n, side="right")) - 1
    found = [own] + ([own - 1] if own and n < all_bands[own][0] else [])
    return [(b, all_bands[b][2]) for b in found]


def region_keys(grams: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """For each band of a set: the band, how many keys it shares with every linked set there at least, its keys.

    A key is the content of a part. Each shingle that two sets differ in changes one part, so of the filled
    parts of a set at most the allowed difference is other in a linked set. A set that has no more filled
    parts than that takes its empty ones as keys too and counts on one; there are parts enough to make such
    sets very rare.
    """
    n, out = len(grams), []
    for band, parts in bands(n, num, den):
        high = size_bands(num, den)[1][band][1]
        most = allowed(min(n + n * den // num, n + high - 1), num, den)
        part = ((grams >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begins = np.flatnonzero(np.diff(part[order], prepend=-1))
        filled = part[order][begins]
        content = np.add.reduceat(_mix(grams[order] * _A), begins)
        least = len(filled) - most
        if least < 1:
            empty = np.setdiff1d(np.arange(parts), filled)
            filled, content, least = np.concatenate([filled, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)]), 1
        place = filled.astype(np.uint64) + np.uint64(band << 32)
        out.append((band, least, _mix(_mix(place * _B + _A) + content * _C)))
    return out


def node_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have the same."""
    return int(_mix(_mix(grams).sum(dtype=np.uint64, keepdims=True) * _B + np.uint64(len(grams))).view(np.int64)[0])


def _lists(flat: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


_KEYS = tuple(f"keys{i}" for i in range(BATCHES))
PRINTS = "doc_id long, n long, node long, first boolean, band int, least int, " + ", ".join(f"{k} array<bigint>" for k in _KEYS)


def _prints(width: int, num: int, den: int):
    """One row per document and band, or one without keys; ``first`` marks one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                sets = shingle_sets(part.column("text"), width)
                nodes = [node_of(s) for s in sets]
                known = part.column("doc_id").is_valid().to_pylist()
                rows, keys = [], []
                for i, (s, node) in enumerate(zip(sets, nodes)):
                    found = region_keys(s, num, den) if known[i] and node not in met else []
                    if known[i]:
                        met.add(node)
                    rows += [(i, j == 0, band, least) for j, (band, least, _) in enumerate(found)] or [(i, True, -1, 0)]
                    keys += [k for _, _, k in found] or [np.zeros(0, np.uint64)]
                if len(met) > REMEMBERED:
                    met = set()
                at = np.array([r[0] for r in rows], np.int64)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
                share = (flat % BATCHES).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(at)), pa.array(np.array([len(s) for s in sets], np.int64)[at]), pa.array(np.array(nodes, np.int64)[at]),
                        pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                        *(_lists(flat[share == i], owner[share == i], len(rows)) for i in range(BATCHES)),
                    ],
                    ["doc_id", "n", "node", "first", "band", "least", *_KEYS],
                )

    return run


def parity_sketch(grams: np.ndarray, high: int) -> np.ndarray:
    """For each bit, whether an odd number of shingles falls on it; two bits a shingle of the band's largest set.

    Two sets differ in at least as many shingles as bits.
    """
    bits = 64 * -(-high // 32)
    odd = np.bincount(((grams >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SETS = "node long, size long, grams array<bigint>, sketches array<struct<band: int, bits: array<bigint>>>"
_SKETCH = pa.struct([("band", pa.int32()), ("bits", pa.list_(pa.int64()))])


def _full_sets(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s for s in shingle_sets(part.column("text"), width) if len(s)]
                if not sets:
                    continue
                high = size_bands(num, den)[1]
                sketches = [[(b, parity_sketch(s, high[b][1])) for b, _ in bands(len(s), num, den)] for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sizes), _lists(np.concatenate(sets).view(np.int64), np.repeat(np.arange(len(sets)), sizes), len(sets)),
                        pa.array([[{"band": b, "bits": x} for b, x in found] for found in sketches], pa.list_(_SKETCH)),
                    ],
                    ["node", "size", "grams", "sketches"],
                )

    return run


def apart(x: Column, y: Column) -> Column:
    """Bits that two sketches differ in."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def regions_of(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, band): members of the regions of two and more that the counts of shared parts leave."""
    shared_parts = None
    for keys in _KEYS:
        part = prints.where(F.size(keys) > 0).select("node", "band", "least", F.explode(keys).alias("key"))
        often = part.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count("*").alias("c")).where("_lo <> _hi").select("key", "c")
        often = scratch.save(often, "often")
        found = scratch.save(part.join(often.hint("merge"), "key").groupBy("node", "band", "least", "key", "c").agg(F.lit(1).alias("_")).drop("_"), "shared")
        scratch.drop(often)
        shared_parts = found if shared_parts is None else shared_parts.unionByName(found)
    own = Window.partitionBy("node", "band")
    ranked = shared_parts.withColumns({"_s": F.count("*").over(own), "_rank": F.row_number().over(own.orderBy("c", "key"))})
    necessary = scratch.save(ranked.where("_s >= least and _rank <= _s - least + 1").select("key", "node", "band"), "necessary")
    scratch.drop(shared_parts)
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    prints_of = necessary.groupBy("key").agg(F.count("*").alias("c"), name(1).alias("f"), name(2).alias("g")).where("c > 1")
    once = prints_of.groupBy("c", "f", "g").agg(F.min("key").alias("key")).select("key")
    regions = scratch.save(necessary.join(once.hint("merge"), "key", "left_semi"), "regions")
    scratch.drop(necessary)
    return regions


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, linked) by the sets themselves; a set of many pairs is a row that skew joins repeat."""
    a = sets.select(F.col("node").alias("x"), F.col("grams").alias("_gx"))
    b = sets.select(F.col("node").alias("y"), F.col("grams").alias("_gy"))
    both = pairs.join(a.hint("merge"), "x").join(b.hint("merge"), "y").select("x", "y", F.size(F.array_intersect("_gx", "_gy")).alias("_c"), (F.size("_gx") + F.size("_gy")).alias("_s"))
    return both.select("x", "y", (F.col("_c").cast("long") * (num + den) >= F.col("_s").cast("long") * num).alias("linked"))


def central_pivots(regions: DataFrame) -> DataFrame:
    """(key, pivot): of each region the member that is in most regions."""
    weight = regions.groupBy("node").agg(F.count("*").alias("_w"))
    return regions.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("_w", "node")).alias("pivot"))


def _far(num: int, den: int) -> Column:
    """The most shingles in which a member can differ from any linked set."""
    n = F.col("size")
    return F.floor((n + F.floor(n * den / num)) * (den - num) / (den + num)).cast("long") + 1


def voronoi_cells(members: DataFrame, scratch: Scratch, num: int, den: int, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Members (key, node, band, size, bits, component) of regions as rows of small cells.

    Result: cell, i, j (block pair), asks, answers, node, size, bits. Each linked pair of a region has a cell
    and block pair where one of the two asks and the other answers.
    """
    row = ["cell", "home", "node", "size", "bits", "component"]
    out = ["cell", "i", "j", "asks", "answers", "node", "size", "bits"]
    open_, done, level = members.withColumn("cell", F.col("key")).withColumn("home", F.lit(True)).select(*row), [], 0
    while True:
        size = open_.groupBy("cell").agg(F.count("*").alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        sized = scratch.save(open_.join(size.where("_lo <> _hi").select("cell", "_n"), "cell"), "cells")
        done.append(sized.where(F.col("_n") <= cell).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("asks"), F.lit(True).alias("answers"), "node", "size", "bits"))
        large = sized.where(F.col("_n") > cell)
        if large.isEmpty():
            break
        level += 1
        h = F.xxhash64(F.lit(level), "node")
        chosen = large.where("home").groupBy("cell", F.pmod(h, F.lit(pivots)).alias("_k")).agg(F.min_by("bits", h).alias("bits"))
        chosen = chosen.groupBy("cell").agg(F.collect_list("bits").alias("_pivots"))
        away = large.join(chosen, "cell").withColumn("_away", F.transform("_pivots", lambda p: apart(p, F.col("bits")))).drop("_pivots")
        nearest = F.array_min("_away")
        fits = F.transform("_away", lambda d: d <= nearest + 2 * _far(num, den))
        away = scratch.save(away.select(*row, "_n", (F.array_position("_away", nearest).cast("int") - 1).alias("_own"), fits.alias("_fits")).withColumn("_own", F.when(F.col("home"), F.col("_own"))), "away")
        # what each pivot's cell would hold, before any row is copied
        ask, hold = [F.count_if(F.col("_own") == p) for p in range(pivots)], [F.count_if(F.coalesce(F.get("_fits", F.lit(p)), F.lit(False))) for p in range(pivots)]
        pairs = sum((a.cast("double") * b for a, b in zip(ask, hold)), F.lit(0.0))
        judged = away.groupBy("cell").agg((pairs * 2 <= F.count_if("home").cast("double") * F.count("*")).alias("_cut"))
        judged = away.join(judged, "cell")
        moved = judged.where("_cut").select(*row, "_own", F.posexplode("_fits").alias("_p", "_in")).where("_in")
        open_ = moved.select(F.xxhash64(F.lit(level), "cell", "_p").alias("cell"), F.coalesce(F.col("_p") == F.col("_own"), F.lit(False)).alias("home"), *row[2:])
        many = F.ceil(F.col("_n") / block).cast("int")
        blocks = judged.where("not _cut").withColumn("_b", F.pmod(F.xxhash64("node"), many).cast("int"))
        whole = blocks.where(F.col("_n") <= block).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("asks"), F.lit(True).alias("answers"), "node", "size", "bits")
        spread = blocks.where(F.col("_n") > block).withColumn("_other", F.explode(F.sequence(F.lit(0), many - 1)))
        asks = spread.where("home").select("cell", F.col("_b").alias("i"), F.col("_other").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers"), "node", "size", "bits")
        answers = spread.select("cell", F.col("_other").alias("i"), F.col("_b").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"), "node", "size", "bits")
        done += [x.select(*out) for x in (whole, asks, answers)]
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return scratch.save(every, "compared")


def _closest(num: int, den: int, limit: int):
    """Pairs of a cell that may link, the ``limit`` closest of each two components; a pair of nulls says that some are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["cell", "i", "j"]):
            node, size, comp, asks, answers = (g.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "component", "asks", "answers"))
            bits = g.column("bits").combine_chunks() if isinstance(g.column("bits"), pa.ChunkedArray) else g.column("bits")
            bits = bits.flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            a, b = np.flatnonzero(asks), np.flatnonzero(answers)
            found = []
            step = max(1, (1 << 21) // max(1, len(b) * bits.shape[1]))
            for s in range(0, len(a), step):
                rows = a[s : s + step]
                d = np.bitwise_count(bits[rows][:, None, :] ^ bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
                fits = d * (den + num) <= (size[rows][:, None] + size[b][None, :]) * (den - num)
                fits &= comp[rows][:, None] != comp[b][None, :]
                p, q = np.nonzero(fits)
                found.append((rows[p], b[q], d[p, q]))
            p, q, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            x, y = np.maximum(node[p], node[q]), np.minimum(node[p], node[q])
            lo, hi = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
            order = np.lexsort((y, x, d, hi, lo))
            x, y, lo, hi = x[order], y[order], lo[order], hi[order]
            new = np.ones(len(x), bool)
            new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            begins = np.flatnonzero(new)
            rank = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x))))
            keep = rank < limit
            cell, i, j = (np.full(int(keep.sum()), g.column(c)[0].as_py()) for c in ("cell", "i", "j"))
            out = [pa.array(x[keep]), pa.array(y[keep]), pa.array(cell, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            if not keep.all():
                out = [pa.concat_arrays([c, pa.array([v], c.type)]) for c, v in zip(out, [None, None, *(g.column(c)[0].as_py() for c in ("cell", "i", "j"))])]
            yield pa.RecordBatch.from_arrays(out, ["x", "y", "cell", "i", "j"])

    return run


def link_classes(docs: DataFrame, prints: DataFrame, reps: DataFrame, scratch: Scratch, width: int, num: int, den: int, cell: int = CELL) -> DataFrame | None:
    """(node, component) over sets; None without any region of two. ``reps``: node and rep, the smallest id."""
    regions = regions_of(prints, scratch)
    if regions.isEmpty():
        return None
    involved = scratch.save(regions.select("node").distinct().join(reps, "node").select("node", F.col("rep").alias("doc_id")), "involved")
    texts = docs.join(involved.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_full_sets(width, num, den), SETS).join(involved.select("node").hint("merge"), "node", "left_semi")
    sets = scratch.save(sets.dropDuplicates(["node"]), "sets")
    sketches = scratch.save(sets.select("node", "size", F.explode("sketches").alias("s")).select("node", "size", "s.band", "s.bits"), "sketches")

    pivot = central_pivots(regions)
    placed = scratch.save(regions.join(pivot, "key").where("node <> pivot"), "placed")
    scratch.drop(regions)
    side = lambda k: sketches.select("band", F.col("node").alias(k), F.col("bits").alias(f"_{k}"), F.col("size").alias(f"_n{k}"))
    first = placed.select(F.col("node").alias("x"), F.col("pivot").alias("y"), "band").distinct().join(side("x"), ["x", "band"]).join(side("y"), ["y", "band"])
    near = apart(F.col("_x"), F.col("_y")) * (den + num) <= (F.col("_nx") + F.col("_ny")) * (den - num)
    pairs = first.where(near).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    met = scratch.save(_verified(pairs, sets, num, den), "met")
    whole = components(scratch, met.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))

    named = lambda df: df.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named(placed).groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("key")
    members = named(placed.join(split, "key", "left_semi").select("key", "node", "band")).join(sketches, ["node", "band"])
    cells = voronoi_cells(members, scratch, num, den, cell)
    scratch.drop(placed)
    limit = 16
    while True:
        sides = named(cells)
        mixed = sides.groupBy("cell", "i", "j").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("cell", "i", "j")
        sides = sides.join(mixed, ["cell", "i", "j"], "left_semi").select("cell", "i", "j", "asks", "answers", "node", "size", "component", "bits")
        ordered = sides.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        found = scratch.save(ordered.mapInArrow(_closest(num, den, limit), "x long, y long, cell long, i int, j int"), "found")
        if found.isEmpty():
            return whole
        fresh = found.where("x is not null").select("x", "y").distinct().join(met.select("x", "y"), ["x", "y"], "left_anti")
        fresh = scratch.save(_verified(fresh, sets, num, den), "met")
        met = met.unionByName(fresh)
        new = fresh.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        if not new.isEmpty():
            whole = components(scratch, whole.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        left = found.where("x is null").select("cell", "i", "j")
        if left.isEmpty():
            return whole
        cells = scratch.save(cells.join(left, ["cell", "i", "j"], "left_semi"), "compared")
        limit *= 16


def join(docs: DataFrame, scratch: Scratch, width: int = 5, num: int = 8, den: int = 10, cell: int = CELL) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_shingles, component_id; linked at similarity num/den or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.save(docs.mapInArrow(_prints(width, num, den), PRINTS), "prints")
    rows = scratch.save(prints.where("first").select("doc_id", "n", "node"), "rows")
    reps = scratch.save(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    whole = link_classes(docs, prints, reps.where("rep is not null"), scratch, width, num, den, cell)
    scratch.drop(prints)
    own = reps.select("node", F.col("rep").alias("component_id"))
    if whole is not None:
        grouped = reps.join(whole, "node")
        least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = grouped.join(least, "component").select("node", "component_id")
        own = own.join(linked.select("node", F.col("component_id").alias("_c")), "node", "left").select("node", F.coalesce("_c", "component_id").alias("component_id"))
    own = scratch.save(own, "own")
    out = rows.join(own.hint("merge"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
