"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets.

Two documents link when the Jaccard similarity of their sets of word shingles is
at least a threshold t (a fraction over 1/2); Jaccard distance is a metric, r = 1 - t.

Pivots of documents alone cannot part this space: unrelated texts all stand at a
distance near 1 from each other and from any pivot, so that windows of the triangle
inequality around far pivots hold every document. So there are two kinds of pivots.

1. *Shingles.* All shingles are ranked (rare ones first, equal ones by hash). A document
   belongs to the regions of the first n - ceil(t n) + 1 of its shingles: were two sets
   to differ in all of these of one of them, their distance would exceed r. So each link
   has a region that holds both ends. Each region has a document as pivot, and the
   regions of one pivot are its cell. A document whose window and half as many
   shingles more are not shared often enough for any link is in no cell.
2. *Documents as pivots, recursively within a cell.* Pivots are taken from a cell and
   measured against its members. Each member goes to the Voronoi cell of its nearest
   pivot, and as a boundary document to those of pivots within 2 r more than that. In a
   pivot's cell, members linked to it are one component and need no comparison with
   each other; by the triangle inequality, one of them can link to another only where
   its distance is not less than the other's less r. Cells of up to LEAF documents and
   ELEMENTS shingles do this within a task (``Sets.forest``), larger ones as joins (``Join._pivots``); what
   a few rounds leave of those is dealt in blocks, so that no cell needs to fit a task.

Before that, distances are bounded from below: a parity bitmap of a set (a bit for each
element, XOR of the elements' bits) differs from another's in no more bits than the
sets differ in elements. Only groups of documents that near bitmaps connect are
compared exactly, from whole texts.

Exact duplicates of a set are one node throughout. Links found are as many as connect a
component: components are exact, and a group of near copies never becomes all its
pairs. (``links`` and ``link_counts`` give all pairs of distinct sets.) Shingles are
64-bit hashes.

Ranking uses a table of at most HEAVY frequent shingles; it steers work only, the
result is the same for any ranking.

Defined cases: a null text or one without words has the empty set, size 0 and no
links; a text of fewer words than a shingle has its whole sequence as one shingle;
texts are read whole; rows that share an id are one document with the links of
all, also where their sets differ; rows with a null id have the component of the rows with an equal set, null if
none of them has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm._arrow import col, slices
from treelake.llm._spark import discard, having, lacking, most_frequent, written
from treelake.llm.components import components

HEAVY = 1 << 16
#: A shingle is a candidate for HEAVY if so many documents of one slice have it.
HEAVY_LEAST = 4
#: A task compares the bitmaps of cells of up to LEAF documents, and sets of groups of up to ELEMENTS shingles.
LEAF, ELEMENTS = 4096, 2 << 20
#: Rounds of pivots in larger cells, and a round's pivots; what is left after them is dealt in blocks.
PIVOT_ROUNDS, PIVOTS = 3, 4
#: Bytes of text whose frequent shingles are counted together, and whose sets are made together.
SLICE, SETS_SLICE = 8 << 20, 2 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class Shingler:
    """Sets of hashed shingles of ``size`` words, from the UTF-8 bytes of many texts at once.

    ASCII white space never occurs inside a longer UTF-8 sequence, so words are
    found on bytes. A word's hash is a polynomial of random 64-bit values of its
    bytes, taken from prefix sums: no step runs word by word.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        values = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
        values[65:91] = values[97:123]  # A-Z as a-z
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 1 << 21)
            base = 0x9E3779B97F4A7C15
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Distinct hashes of each text, ascending (unsigned)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):  # about a megabyte at once, a longer text alone
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 20), "right")) - 1)
            out += self._part(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            start = end
        return out

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        none = np.zeros(0, np.uint64)
        if not n:
            return [none] * (len(offsets) - 1)
        self._grow(n + 1)
        gap = np.ones(n + 1, bool)  # whether a word can't go on from the byte before
        inside = ~self.space[data]
        gap[1:n] = ~inside[:-1]
        gap[offsets] = True
        starts = np.flatnonzero(inside & gap[:n])
        stop = np.ones(n, bool)
        stop[:-1] = ~inside[1:]
        stop[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(inside & stop) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        first = np.searchsorted(starts, offsets)  # of each text's words
        k = self.size
        rolled = self._roll(h, k) if len(h) >= k else none
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(np.unique(rolled[a : b - k + 1]) if b - a >= k else self._roll(h[a:b], b - a) if b > a else none)
        return out

    @staticmethod
    def _roll(h: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k words that follow one another."""
        m = len(h) - k + 1
        out = np.full(m, k, np.uint64)
        for j in range(k):
            out ^= out >> np.uint64(29)
            out = (out + h[j : j + m]) * _ODD[j % len(_ODD)]
        out ^= out >> np.uint64(32)
        return out * _ODD[0]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap: a power of two of at least as many bits as elements, 128 or more."""
    bits = max(128, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def ranked(hashes: np.ndarray, heavy: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rare shingles by hash, then heavy ones (ascending array) by their order."""
    if not len(heavy):
        return hashes
    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
    is_heavy = heavy[at] == hashes
    if not is_heavy.any():
        return hashes
    return np.concatenate([hashes[~is_heavy], hashes[is_heavy][np.argsort(order[at[is_heavy]], kind="stable")]])


def _heavy(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                h, n = np.unique(np.concatenate(make.sets(batch.column(1).slice(a, b - a))), return_counts=True)
                keep = n >= HEAVY_LEAST
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

    counts = docs.select("i", "t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = written(counts, "jaccard-counts")
    top = most_frequent(counts, HEAVY).toPandas()
    discard(counts)
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, top["n"].to_numpy()))] = np.arange(len(h))
    return h[by], place[by]


def _profile(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(i, n, key, prefix, bits): of each row its set's size, digest, ranked wide window, and bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(_heavy(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (heavy, order) = Shingler(size), held.value
        for batch in batches:
            ids = batch.column(0)
            for a, b in slices(batch.column(1), SETS_SLICE):
                n, keys, prefixes, bits = [], [], [], []
                for k, h in enumerate(make.sets(batch.column(1).slice(a, b - a))):
                    n.append(len(h))
                    if not len(h):
                        keys.append(f"empty {ids[a + k].as_py()}".encode())  # never looked up; spreads empty texts
                        prefixes.append(np.zeros(0, np.int64))
                        bits.append(prefixes[-1])
                        continue
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    window = len(h) - -(-num * len(h) // den) + 1
                    prefixes.append(ranked(h, heavy, order)[: window + (window + 1) // 2].view(np.int64))
                    bits.append(bitmap(h))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["i", "n", "key", "prefix", "bits"]
                )

    return docs.select("i", "t").mapInArrow(run, "i long, n long, key binary, prefix array<long>, bits array<long>")


def _cut_runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal ``by`` from batches sorted by it: a table and where its runs begin, with its end."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        key = t[by].to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield t.slice(0, last), np.concatenate([[0], cuts])
        held = t.slice(last)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])
    pa.default_memory_pool().release_unused()  # a worker outlives the task


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Join:
    def __init__(self, docs: DataFrame, size: int, num: int, den: int, leaf: int = LEAF, elements: int = ELEMENTS) -> None:
        if not den < 2 * num <= 2 * den:
            raise ValueError("the threshold must be over 1/2 and at most 1")
        self.docs, self.size, self.num, self.den, self.leaf = docs, size, num, den, leaf
        self.elements, self.r = elements, 1 - num / den

    def run(self) -> DataFrame:
        """(i, n, component) of each row."""
        rows, classes = self._nodes()
        links = self._same_id(rows, classes)
        cells, found = self._dealt(self._cells(), False)
        links = links if found is None else links.unionByName(found)
        groups, found = self._dealt(self._near(cells), True)
        links = links if found is None else links.unionByName(found)
        labels = components(links.unionByName(self._exact(groups, every=False).select("a", "b")))
        named = classes.join(labels, "node", "left").select(F.col("key").alias("k"), F.coalesce("component", "node").alias("component"))
        out = rows.join(named, F.col("key") == F.col("k"), "left")
        return out.select("i", "n", F.coalesce("component", F.when(F.col("n") == 0, F.col("i"))).alias("component"))

    def pairs(self) -> tuple[DataFrame, DataFrame]:
        """(i, n, node) of each row, and (a, b, differ, total) of every link between nodes, those within a component too.

        A node is the least id with a set. Nothing is left out that the components already tell: in a group of
        m distinct near copies all of up to m (m - 1) / 2 pairs are compared.
        """
        rows, classes = self._nodes()
        cells, _ = self._dealt(self._cells(), False, every=True)
        groups, _ = self._dealt(self._near(cells), True, every=True)
        links = self._exact(groups, every=True)
        named = rows.join(classes.select(F.col("key").alias("k"), "node"), F.col("key") == F.col("k"), "left")
        return named.select("i", "n", "node"), links

    def _dealt(self, cells: DataFrame, elements: bool, every: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(cell, node, label): cells small enough for a task, and links (a, b) found on the way.

        every: all pairs of a large cell stay, and not only those that its pivots leave.
        """
        large = self._large(cells, elements)
        if not large.limit(1).count():
            return self._small(cells, None), None
        rest, links = cells.join(large.select("cell"), "cell", "left_semi"), None
        if every:
            rest = rest.withColumn("label", F.col("node"))
        else:
            rest, links = self._pivots(rest)
        return self._small(cells, large).unionByName(self._blocks(rest)), links

    # Documents, sets and cells

    def _nodes(self) -> tuple[DataFrame, DataFrame]:
        """(i, n, key) of each row and (key, node) of each distinct set; sets self.nodes."""
        profile = written(_profile(self.docs, self.size, self.num, self.den), "jaccard-profile")
        least = profile.where("n > 0 AND i IS NOT NULL").groupBy("key").agg(F.min(F.struct("i", "n", "prefix", "bits")).alias("x"))
        self.nodes = written(least.select("key", F.col("x.i").alias("node"), "x.n", "x.prefix", "x.bits"), "jaccard-nodes")
        rows = written(profile.select("i", "n", "key"), "jaccard-rows")
        discard(profile)
        return rows, self.nodes.select("key", "node")

    def _same_id(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): the nodes of rows with one id and several sets."""
        known = rows.where("n > 0 AND i IS NOT NULL").groupBy("i").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("i")
        several = rows.join(known, "i", "left_semi").where("n > 0").join(classes.select(F.col("key").alias("k"), "node"), F.col("key") == F.col("k")).select("i", "node").distinct()
        return several.join(several.groupBy("i").agg(F.min("node").alias("a")), "i").select("a", F.col("node").alias("b"))

    def _cells(self) -> DataFrame:
        """(cell, node, n): a document in the cells of the pivots of its regions.

        A region's pivot is its document of least id, and a pivot's cell the union of its regions: near copies,
        which share most of their regions, meet once and not in each of them. Two linked sets, whose overlap is
        at least ceil(t n) for the size n of either, have their first k common shingles within the first
        n - ceil(t n) + k of both; so a document of which fewer shingles than that k, taken for its least
        possible partner, are shared within wide windows links to nothing. A passage that others have too
        doesn't make a document a member.
        """
        up = lambda n: F.floor((n * self.num + self.den - 1) / self.den)
        n = F.col("n")
        lacks, partner_lacks = n - up(n), up(n) - up(up(n))
        least = F.least(up(n) - partner_lacks, 1 + F.floor((partner_lacks + 2) / 2))
        homes = self.nodes.select("node", "n", F.posexplode("prefix").alias("pos", "region"))
        regions = homes.groupBy("region").agg(F.count("*").alias("c"), F.min("node").alias("cell")).where("c > 1").select("region", "cell")
        shared = homes.join(regions, "region").groupBy("node", "n").agg(F.count("*").alias("met"), F.collect_set(F.when(F.col("pos") <= lacks, F.col("cell"))).alias("cells"))
        return written(shared.where(F.col("met") >= least).select(F.explode("cells").alias("cell"), "node", "n"), "jaccard-cells")

    def _large(self, cells: DataFrame, elements: bool = False) -> DataFrame:
        """(cell, c) of cells of over ``leaf`` documents, or ELEMENTS shingles, which don't go to a task whole."""
        sizes = cells.groupBy("cell").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        many = (F.col("w") > self.elements) & (F.col("c") > 2) if elements else F.col("c") > self.leaf
        return written(sizes.where(many).select("cell", "c"), "jaccard-large")

    def _small(self, cells: DataFrame, large: DataFrame | None) -> DataFrame:
        out = cells if large is None else cells.join(large.select("cell"), "cell", "left_anti")
        return out.select("cell", "node", F.col("node").alias("label"))

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """(node, h): the sets of documents, from their whole texts."""
        texts = having(self.docs.select("i", "t"), nodes.select("node"), F.col("i"))
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Shingler(size)
            for batch in batches:
                for a, b in slices(batch.column(1), SETS_SLICE):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h.view(np.int64) for h in make.sets(batch.column(1).slice(a, b - a))], pa.list_(pa.int64()))], names=["node", "h"])

        return written(texts.mapInArrow(run, "node long, h array<long>"), "jaccard-sets")

    # Large cells

    def _pivots(self, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rounds of PIVOTS documents of each large cell against all its members.

        Gives what is still to be compared (cell, node, n, label, c), and links (a, b). Members linked to one
        pivot are one component, whose members need no comparison with each other.
        """
        sets = self._sets(cells)
        found: list[DataFrame] = []
        rest = written(cells.join(cells.groupBy("cell").agg(F.count("*").alias("c")), "cell").select("cell", "node", "n", F.col("node").alias("label"), "c"), "jaccard-rest")
        for k in range(PIVOT_ROUNDS):
            measured = self._measure(rest, sets, k)
            found.append(measured.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
            links = found[0]
            for x in found[1:]:
                links = links.unionByName(x)
            rest = self._parted(rest, measured, components(links))
            if not rest.where(F.col("c") > self.leaf).limit(1).count():
                break
        return rest, links

    def _measure(self, rest: DataFrame, sets: DataFrame, k: int) -> DataFrame:
        """(cell, node, pivot, d, linked): distances of members to the cell's pivots.

        Members are dealt by hash to parts of about ``leaf``; a cell's pivots go to each of its parts.
        Pivots are the members of least hash, a component's that is no majority first.
        """
        few = F.when(F.col("label") == F.col("node"), 0).otherwise(1)
        least = [F.min(F.struct(few.alias("few"), F.xxhash64(F.lit(k * PIVOTS + s), "node").alias("h"), "node")).alias(f"p{s}") for s in range(PIVOTS)]
        pivots = rest.groupBy("cell").agg(F.first("c").alias("c"), *least)
        parts = F.ceil(F.col("c") / self.leaf).cast("int")
        pivots = pivots.select("cell", parts.alias("parts"), F.explode(F.array_distinct(F.array(*[F.col(f"p{s}.node") for s in range(PIVOTS)]))).alias("pivot"))
        pivots = pivots.join(sets.select(F.col("node").alias("pivot"), F.col("h").alias("ph")), "pivot").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivot", "ph")
        members = rest.select("cell", "node", F.pmod(F.xxhash64(F.lit(-1), "node"), parts).cast("int").alias("part")).join(sets, "node")
        both = F.size(F.array_intersect("h", "ph"))
        total = F.size("h") + F.size("ph")
        out = members.join(pivots, ["cell", "part"]).select("cell", "node", "pivot", (1 - both / (total - both)).alias("d"), (both * (self.num + self.den) >= total * self.num).alias("linked"))
        return written(out.groupBy("cell", "node", "pivot").agg(F.min("d").alias("d"), F.max("linked").alias("linked")), "jaccard-measured")

    def _parted(self, rest: DataFrame, measured: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of cells that hold more than one component, without what the pivots have done.

        Voronoi cells: a document goes to the pivots that are no farther than its nearest one and 2 r, so
        linked documents meet in the nearest pivot's cell of either. In a pivot's cell, one that is linked to
        it stays only if its distance is not less than that of one that isn't, less r: the triangle inequality
        parts it from all others. Where the windows don't part a cell, it stays one.
        """
        r, eps = self.r, 1e-9
        labels = labels.select(F.col("node").alias("who"), "component")
        nearest = measured.groupBy("cell", "node").agg(F.min("d").alias("nearest"), F.max(F.col("node") == F.col("pivot")).alias("done"))
        near = measured.join(nearest.where("NOT done"), ["cell", "node"]).where(F.col("d") <= F.col("nearest") + 2 * r + eps)
        far = near.where("NOT linked").groupBy("cell", "pivot").agg(F.min("d").alias("least"))
        near = near.join(far, ["cell", "pivot"]).where(~F.col("linked") | (F.col("d") >= F.col("least") - r - eps)).select("cell", "pivot", "node")
        sums = near.groupBy("cell").agg(F.count("*").alias("rows")).join(rest.groupBy("cell").agg(F.first("c").alias("c")), "cell")
        parted = sums.select("cell", (F.col("rows") <= F.col("c") * 5 / 4).alias("parted"))
        rest = rest.drop("label", "c").join(nearest.where("NOT done").select("cell", "node"), ["cell", "node"])
        split = near.join(parted.where("parted"), "cell").join(rest, ["cell", "node"]).select(F.xxhash64("cell", "pivot").alias("cell"), "node", "n")
        whole = rest.join(parted.where("NOT parted"), "cell").select("cell", "node", "n")
        out = split.unionByName(whole).join(labels, F.col("node") == F.col("who"), "left").select("cell", "node", "n", F.coalesce("component", "node").alias("label"))
        out = written(out, "jaccard-parted")
        mixed = out.groupBy("cell").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cell", "c")
        return written(out.join(mixed, "cell"), "jaccard-rest")

    def _blocks(self, rest: DataFrame) -> DataFrame:
        """(cell, node, label): cells dealt in blocks of half of ``leaf`` and ELEMENTS, each two blocks that may hold a pair in one cell.

        Members of the most frequent component are compared with the others only, so that with few others the rows grow as the cell.
        """
        counts = rest.groupBy("cell", "label").agg(F.count("*").alias("c"), F.max("n").alias("n")).groupBy("cell").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("n").alias("n"))
        half = F.greatest(F.lit(1), F.least(F.lit(self.leaf // 2), F.floor(self.elements / (2 * F.col("n")))))
        blocks = lambda c: F.greatest(F.ceil(c / half), F.lit(1)).cast("int")
        counts = counts.select("cell", F.col("top.label").alias("main"), blocks(F.col("top.c")).alias("mains"), blocks(F.col("all") - F.col("top.c")).alias("others"))
        rows = rest.select("cell", "node", "label").join(counts, "cell").withColumn("is_main", F.col("label") == F.col("main"))
        own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
        rows = rows.withColumn("own", own)
        cross = rows.select("cell", "node", "label", "own", F.col("is_main").alias("m"), F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("mains")) - 1)).alias("other"))
        cross = cross.select(F.xxhash64("cell", F.lit("main"), F.when(F.col("m"), F.col("own")).otherwise(F.col("other")), F.when(F.col("m"), F.col("other")).otherwise(F.col("own"))).alias("cell"), "node", "label")
        among = rows.where("NOT is_main").select("cell", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
        among = among.select(F.xxhash64("cell", F.lit("other"), F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "label")
        return cross.unionByName(among)

    # Small cells

    def _near(self, cells: DataFrame) -> DataFrame:
        """(cell, node, n): groups of a cell's members that a chain of near bitmaps connects; the same group of several cells is one."""
        rows = cells.join(self.nodes.select("node", "n", "bits"), "node").select("cell", "n", "node", "label", "bits").repartition("cell").sortWithinPartitions("cell", "n", "node")
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, cuts in _cut_runs(batches, "cell"):
                node, n, label = (t[k].to_numpy() for k in ("node", "n", "label"))
                bits, g, out, sizes = [x.view(np.uint64) for x in _lists(t["bits"])], [], [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    for group in _groups(n[a:b], label[a:b], bits[a:b], num, den):
                        ids, at = np.unique(node[a:b][group], return_index=True)
                        if len(ids) > 1:
                            out.append(ids)
                            sizes.append(n[a:b][group][at])
                            g.append(np.full(len(ids), np.frombuffer(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), np.int64)[0]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (g, out, sizes)], names=["cell", "node", "n"])

        return written(rows.mapInArrow(run, "cell long, node long, n long").dropDuplicates(["cell", "node"]), "jaccard-groups")

    def _exact(self, groups: DataFrame, every: bool) -> DataFrame:
        """(a, b, differ, total) of linked sets of the groups: all links, or else as many as connect what is linked."""
        sets = self._sets(groups)
        rows = groups.select("cell", "node").join(sets, "node").select("cell", "node", "h").repartition("cell").sortWithinPartitions("cell", "node")
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, cuts in _cut_runs(batches, "cell"):
                node, h = t["node"].to_numpy(), _lists(t["h"])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    one = Sets(h[a:b], num, den)
                    x, y, differ, total = one.all() if every else one.forest()
                    if len(x):
                        ends = np.sort(np.stack([node[a:b][x], node[a:b][y]]), 0)
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (*ends, differ, total)], names=["a", "b", "differ", "total"])

        links = rows.mapInArrow(run, "a long, b long, differ long, total long").where("a <> b")
        out = written(links.groupBy("a", "b").agg(F.min(F.struct("differ", "total")).alias("x")).select("a", "b", "x.differ", "x.total") if every else links, "jaccard-links")
        discard(sets)
        return out


def _groups(n: np.ndarray, label: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Members, in ascending size, that pairs of like size, different label and near bitmaps connect.

    A row looks only at those up to its size window's end, whose longer bitmaps are folded to its own length.
    """
    ends = np.searchsorted(n, n * den // num, "right")
    own, group = np.unique(label, return_inverse=True)[1], np.arange(len(n))
    folded: dict[int, tuple[int, np.ndarray]] = {}  # by width: rows from the first of that width on
    widths = np.array([len(x) for x in bits])
    for i in range(len(n) - 1):
        width, end = int(widths[i]), int(ends[i])
        if end == i + 1:
            continue
        if width not in folded:
            most = int(ends[np.flatnonzero(widths == width)[-1]])
            folded[width] = i, np.stack([x if len(x) == width else np.bitwise_xor.reduce(x.reshape(-1, width), 0) for x in bits[i:most]])
        first, table = folded[width]
        differ = np.bitwise_count(table[i + 1 - first : end - first] ^ bits[i]).sum(1, dtype=np.int64)
        js = i + 1 + np.flatnonzero((differ * (num + den) <= (n[i + 1 : end] + n[i]) * (den - num)) & (own[i + 1 : end] != own[i]))
        if len(js) and (group[js] != group[i]).any():
            group[np.isin(group, group[js])] = group[i]
    order = np.argsort(group, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(x) > 1]


class Sets:
    """Exact distances among a few sets of shingles."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.n = np.array([len(x) for x in sets])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.num, self.den, self.r = num, den, 1 - num / den

    def shared(self, i: int) -> np.ndarray:
        """How many elements each set has in common with set i."""
        own = self.flat[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[self.flat], self.at[:-1], dtype=np.int64)
        self.mark[own] = False
        return out

    def linked(self, i: int, shared: np.ndarray) -> np.ndarray:
        return shared * (self.num + self.den) >= self.num * (self.n + self.n[i])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, differ, total) of all links, x < y."""
        out = []
        for i in range(len(self.n) - 1):
            shared = self.shared(i)
            y = i + 1 + np.flatnonzero(self.linked(i, shared)[i + 1 :])
            total = self.n[y] + self.n[i]
            out.append((np.full(len(y), i), y, total - 2 * shared[y], total))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, 0, 0): for each set but the least of what is linked, a pair with the least.

        Pivots are taken until each set is within r of one. Their Voronoi cells are widened by the windows of
        the triangle inequality, and within a widened cell sets that aren't connected yet are compared.
        """
        m = len(self.n)
        label, far, pivots, distance = np.arange(m), np.ones(m, bool), [], []
        while far.any():
            p = int(np.argmax(far))
            shared = self.shared(p)
            linked = self.linked(p, shared)
            label[np.isin(label, label[linked])] = label[linked].min()
            far &= ~linked
            pivots.append(p)
            distance.append(1 - shared / (self.n + self.n[p] - shared))
        if (label != label[0]).any():
            d = np.stack(distance)
            home, nearest = d.argmin(0), d.min(0)
            for q, p in enumerate(pivots):
                window = np.flatnonzero(d[q] <= nearest + 2 * self.r + 1e-9)
                if (label[window] == label[p]).all():
                    continue
                for y in np.flatnonzero(home == q):
                    other = window[(label[window] != label[y]) & (np.abs(d[q, window] - d[q, y]) <= self.r + 1e-9)]
                    if y != p and len(other):
                        linked = self.linked(y, self.shared(y))
                        label[np.isin(label, label[linked])] = label[linked].min()
        least = {}
        for k, x in enumerate(label.tolist()):
            least.setdefault(x, k)
        y = np.flatnonzero(np.array([least[x] for x in label.tolist()]) != np.arange(m))
        x = np.array([least[k] for k in label[y].tolist()], np.int64)
        return x, y, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, leaf: int = LEAF) -> DataFrame:
    """(id, n_shingles, component_id) of each row; ids are whole numbers, linked at a similarity of num / den or more."""
    docs = df.select(col(id_col).cast("long").alias("i"), col(text_col).cast("string").alias("t"))
    out = Join(docs, size, num, den, leaf).run()
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, leaf: int = LEAF) -> DataFrame:
    """(a, b, similarity) of every two distinct sets that link, each named by the least id that has it; a < b."""
    docs = df.select(col(id_col).cast("long").alias("i"), col(text_col).cast("string").alias("t"))
    found = Join(docs, size, num, den, leaf).pairs()[1]
    return found.select("a", "b", ((F.col("total") - F.col("differ")) / (F.col("total") + F.col("differ"))).alias("similarity"))


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, leaf: int = LEAF) -> DataFrame:
    """(id, class_id, n_links) of each row: the least id with an equal set, and how many other documents it links to.

    Copies count each, equal ones too; rows that share an id count once for each set. Null texts and texts without a word have no class and no links; a row with a
    null id has the class and links of its set, and is no document for others.
    """
    docs = df.select(col(id_col).cast("long").alias("i"), col(text_col).cast("string").alias("t"))
    rows, found = Join(docs, size, num, den, leaf).pairs()
    sizes = rows.where("node IS NOT NULL AND i IS NOT NULL").groupBy("node").agg(F.countDistinct("i").alias("m"))
    both = found.select("a", "b").union(found.select("b", "a"))
    near = both.join(sizes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("others"))
    out = rows.join(sizes, "node", "left").join(near, "node", "left")
    same = F.coalesce("m", F.lit(0)) - F.when(F.col("node").isNotNull() & F.col("i").isNotNull(), 1).otherwise(0)
    return out.select(F.col("i").alias(id_col), F.col("node").alias("class_id"), (same + F.coalesce("others", F.lit(0))).alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of df, all columns, but of each group of linked documents only the one with the least id.

    Of rows that share an id the one of least text stays, of equal ones that of the least JSON form; rows with a
    null id, which no other row can stand for, all stay. Whole rows are shuffled only for repeated ids, or where over
    BROADCAST_ROWS ids go.
    """
    found = written(link(df, id_col, text_col, size, num, den).where(col(id_col).isNotNull()), "jaccard-found")
    key = col(id_col).cast("long")
    kept = lacking(df, found.where(col(id_col) != F.col("component_id")).select(id_col), key)
    several = found.groupBy(id_col).count().where("count > 1").select(id_col)
    if not several.limit(1).count():
        return kept
    row = F.struct(*map(col, df.columns))
    one = having(kept, several, key).groupBy(key.alias("__id")).agg(F.min_by(row, F.struct(col(text_col), F.to_json(row))).alias("__row"))
    return lacking(kept, several, key).unionByName(one.select("__row.*"))
