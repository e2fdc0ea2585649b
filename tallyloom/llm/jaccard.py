"""Similarity join of documents on their sets of word n-grams: no link is lost.

Texts with equal sets form classes first; from then on a class is one row. Two sets of sizes
m <= n can have a Jaccard similarity of t only if m >= t * n and they share one of the first
n - ceil(t * n) + 1 elements in any order that is the same for all. The order puts n-grams that
very many documents share last, so a passage found everywhere brings nobody together. By the same
count partners share many of the first elements, so documents that share few of theirs with
anybody are settled alone before pairs are made.

The classes left meet in size-banded tiles. Sizes are cut into bands so that partners are of one
band or of neighbouring ones; a class takes part in its own band and in the next. Partners in a
band differ in at most d elements. The elements are dealt by a hash into about twice d tiles, so
many tiles of two partners hold the very same elements: (band, tile, hash of its elements) is the
key they meet by. As partners have a known number c of keys in common, a class that shares fewer
has none, and each may leave its c - 1 most frequent keys out: sets that share a good part but not
enough of their elements rarely meet. A class with so many empty tiles that this count fails for it
meets the others by the first elements instead. Candidates are compared by bitmap signatures as wide as their sets:
each bit is the parity of the elements hashed to it, so the number of differing bits bounds the
number of differing elements from below and the overlap from above. Pairs that this bound leaves
are decided by intersecting the sorted arrays.

A large group of near copies would be quadratic. So a few rounds come first in which each class
tries one partner, the closest by signature among the hubs of its groups. A group's hub is the
member whose keys are the most frequent ones, so of copies of one text the text that is nearest to
all of them, if it is there; later rounds take hubs of other components. Only pairs between
different components of those rounds' links are then compared further, however many; keys with the
same members count once there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.words import chunks, hash_windows, hash_words, mix, slices
from tallyloom.session import materialise, small_batches

#: Elements kept as frequent; they only order the search, whatever their number.
FREQUENT = 1 << 16
#: A task reports the elements that this many of about `WINDOW` / set size documents share.
SEEN, WINDOW = 4, 2_000_000
#: Documents and characters of them that a task has in hand at a time: a Python worker keeps the memory of its largest arrays.
SLICE, CHARACTERS = 256, 250_000
#: Tiles beyond those that partners can differ in: a share of them and a number.
SPARE = 1.0, 4
#: Rounds of one partner each before pairs are made; they decide only how many pairs are left.
ROUNDS = 3
#: Rows of elements that a task sorts and groups at a time; more rows go to more tasks.
ROWS = 250_000
#: Words of 64 bits in a signature that a join compares first, and at most in one that it compares then.
SHORT, WIDE = 8, 128
#: Bits of the filter that tells which documents' arrays are wanted (1 MB).
FILTER_BITS = 1 << 23


def element_sets(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text.

    ASCII capitals are lower-cased and ASCII white space parts words. A text of fewer words is
    one element; one without words has none.
    """
    out: list[np.ndarray] = []
    for start, end in chunks(blobs, CHARACTERS):
        words, at = hash_words([b.lower() for b in blobs[start:end]])
        grams = hash_windows(words, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mix(short + words[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def repeated(elements: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that are there so many times at least, and how many times; sorts the array in place."""
    elements.sort()
    again = elements[times - 1 :][elements[times - 1 :] == elements[: max(0, len(elements) - times + 1)]]
    first = np.flatnonzero(np.append(True, again[1:] != again[:-1])[: len(again)])
    return again[first], np.diff(first, append=len(again)) + times - 1


def bitmap(elements: np.ndarray) -> bytes:
    """Parities of the elements hashed to each of 64, 128, ... bits, at least as many as elements."""
    bits = 64
    while bits < len(elements):
        bits *= 2
    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def signature(elements: np.ndarray) -> np.ndarray:
    """The bitmap with at least two bits for each element (but SHORT to WIDE words), as whole numbers for a join."""
    words = SHORT
    while 64 * words < 2 * len(elements) and words < WIDE:
        words *= 2
    parity = np.bincount((elements & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64)


def far_sql(x: str, y: str) -> str:
    """SQL for the number of differing bits of two signatures; the longer one is folded to the shorter."""
    fold = lambda a, b: f"if(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (p, q) -> p ^ q), {a})"
    return f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (u, v) -> u + v)"


def band_edges(largest: int, num: int, den: int) -> list[int]:
    """First sizes of the bands, beyond `largest`: a partner of a band's size is at most in the next."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * den // num + 1)
    return [*edges, edges[-1] * den // num + 1]


def tiles_of(band: int, edges: list[int], num: int, den: int) -> tuple[int, int]:
    """(elements in which partners in a band differ at most, tiles of the band)."""
    most = 2 * (edges[band + 1] - 1) * (den - num) // (den + num)
    return most, most + int(most * SPARE[0]) + SPARE[1]


def tile_keys(elements: np.ndarray, edges: list[int], num: int, den: int) -> list[tuple[int, np.ndarray, int]]:
    """For a set's own band and the next: (band, its keys there, how many of them any partner shares).

    Of the tiles of two partners at least tiles - most are equal, and those that hold elements in
    either hold them in both, so what is left after the empty ones are shared keys.
    """
    own = int(np.searchsorted(edges, len(elements), "right")) - 1
    out = []
    scattered = mix(elements + np.uint64(0x51ED270B))
    for band in (own, own + 1):
        most, count = tiles_of(band, edges, num, den)
        tile = (((scattered >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, tile, mix(scattered))
        held = np.flatnonzero(np.bincount(tile, minlength=count))
        keys = mix(mix(sums[held]) + held.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        out.append((band, keys, len(held) - most))
    return out


def differing(a: bytes, b: bytes) -> int:
    """Elements in which two sets differ at least; the longer bitmap is folded to the shorter."""
    x, y = (int.from_bytes(v, "little") for v in (a, b))
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _blobs(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


class JaccardJoin:
    """Links at intersection * den >= num * union, between documents' sets of word n-grams."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100):
        """Ids are taken as numbers; rows that share an id count as one document, but for null ids."""
        small_batches(docs.sparkSession)
        self.width, self.num, self.den, self.id_col = width, num, den, id_col
        self.all = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        self.texts = self.all.where("id is not null")
        self._read()

    def _read(self) -> None:
        """Set size, fingerprint and bitmap of every document; frequent elements; classes."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            window, filled = np.empty(WINDOW, np.uint64), 0

            def frequent(elements: np.ndarray) -> pa.RecordBatch:
                values, counts = repeated(elements, SEEN)
                return _rows(element=values.view(np.int64), n=counts)

            for batch in slices(batches, SLICE):
                sets = element_sets(_blobs(batch.column(1)), width)
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield _rows(id=batch.column(0), n=np.array([len(s) for s in sets], np.int64), mark=marks, bits=[bitmap(s) for s in sets], digest=batch.column(2))
                found = np.concatenate([np.zeros(0, np.uint64), *sets])
                if filled + len(found) > WINDOW:
                    yield frequent(window[:filled])
                    filled = 0
                if len(found) > WINDOW:
                    yield frequent(found)
                else:
                    window[filled : filled + len(found)] = found
                    filled += len(found)
            if filled:
                yield frequent(window[:filled])

        told = self.all.select("id", "text", F.xxhash64("text").alias("digest"))
        facts = materialise(told.mapInArrow(run, "id long, n long, mark binary, bits binary, digest long, element long"), "sets")
        self.sets = facts.where("element is null").drop("element")
        top = (facts.where("element is not null").groupBy("element").agg(F.sum("n").alias("n"))
               .orderBy(F.desc("n"), "element").limit(FREQUENT).toArrow())  # bounded: FREQUENT rows
        values = top.column("element").to_numpy().view(np.uint64)
        order = np.argsort(values)
        self.frequent = values[order], top.column("n").to_numpy()[order]
        self.classes = materialise(self.sets.where("n > 0 and id is not null").groupBy("mark").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")

    @staticmethod
    def _dealt(rows: DataFrame, count: int | None) -> DataFrame:
        """Rows dealt by element; about `count` of them, in as many parts as keep a task's sort small."""
        parts = -(-(count or 0) // ROWS)
        few = parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition("element") if few else rows.repartition(parts, "element")

    def _sharing(self) -> DataFrame:
        """(element, id, n, hub): the classes that share a search element, hub the smallest of them.

        With p search elements, partners share as many as p (of the smaller set) of the first
        2 * p - 1. So a class that shares fewer of those with anybody has no partner; such
        classes leave before any pair is made, and those that then share too few leave too.
        """
        width, num, den = self.width, self.num, self.den
        frequent = self.texts.sparkSession.sparkContext.broadcast(self.frequent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, weights = frequent.value
            for batch in slices(batches, SLICE):
                ids, sizes, found, early = [], [], [], []
                for i, s in zip(batch.column(0).to_pylist(), element_sets(_blobs(batch.column(1)), width)):
                    if not len(s):
                        continue
                    if len(values):
                        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        common = values[at] == s
                        if common.any():
                            s = s[np.lexsort((s, np.where(common, weights[at], 0)))]
                    p = len(s) + (-num * len(s)) // den + 1
                    ids.append(i)
                    sizes.append(2 * p - 1)
                    found.append(s[: 2 * p - 1])
                    early.append(np.arange(2 * p - 1) < p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.concatenate([np.zeros(0, bool), *early]))],
                    names=["element", "id", "early"])

        places = self.texts.mapInArrow(run, "element long, id long, early boolean")
        p = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
        count = self.sets.where("n > 0 and id is not null").agg(F.sum(2 * p - 1)).first()[0]
        places = self._dealt(places.where("element is not null and id is not null"), count)  # dealt once, read twice
        # both sides read every column and have the same conditions, so Spark deals the rows out once
        twice = by_two(places, F.max("early").alias("some")).select("element", "some")
        shared = places.join(twice, "element").join(self.classes.select(F.col("rep").alias("id"), "n"), "id")
        shared = materialise(shared.select("element", "id", "n", "early", "some"), "shared").drop("some")
        least = F.expr(f"({self.num} * n + {self.den - 1}) div {self.den}")  # the smallest partner's size
        need = least - F.expr(f"({self.num} * m + {self.den - 1}) div {self.den}") + 1
        for _ in range(2):
            mine = shared.join(by_two(shared).select("element"), "element")
            rich = mine.groupBy("id").agg(F.count("*").alias("held"), F.first("n").alias("n")).withColumn("m", least).where(F.col("held") >= need).select("id")
            shared = materialise(mine.join(rich, "id"), "shared")
        first = shared.where("early")
        return materialise(first.join(by_two(first), "element").select("element", "id", "n", "hub"), "sharing")

    def _groups(self) -> DataFrame:
        """(element, id, n, weight, hub): the classes that share a tile, or, where tiles may not do, a search element."""
        sharing = self._sharing()
        num, den = self.num, self.den
        self.arrays = self._arrays(sharing.select("id").distinct())
        largest = self.classes.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        edges = band_edges(largest, num, den)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices([batch], 128):
                    told = [(i, len(blob) // 8, *of_band) for i, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                            for of_band in tile_keys(np.frombuffer(blob, np.uint64), edges, num, den)]
                    ids, n, bands, keys, common = zip(*told)
                    sizes = [len(k) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in (ids, n, bands, common))],
                        names=["element", "id", "n", "band", "common"])

        keyed = self.arrays.mapInArrow(run, "element long, id long, n long, band long, common long")
        keys = self.classes.join(self.arrays.select(F.col("id").alias("rep")), "rep", "left_semi").agg(F.sum(F.col("n") + SPARE[1])).first()[0]
        tiles = self._dealt(keyed, keys)
        met = tiles.join(by_two(tiles).drop("hub"), "element").withColumnRenamed("n_ids", "times")
        unsure = materialise(keyed.where("common < 1").select("id").distinct(), "unsure")
        # of its keys in a band that others have too, a class leaves the (common - 1) most frequent ones out
        mine = Window.partitionBy("id", "band")
        ranked = met.withColumn("place", F.row_number().over(mine.orderBy("times", "element"))).withColumn("shared", F.count("*").over(mine)).withColumn("weight", F.sum("times").over(mine))
        kept = materialise(ranked.where("place <= shared - greatest(common, 1) + 1").select("element", "id", "n", "weight"), "tiles")
        kept = self._dealt(kept, kept.count())
        met = materialise(kept.join(by_two(kept).select("element"), "element"), "met")
        hubs = met.groupBy("element").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
        met = met.join(hubs, "element").select("element", "id", "n", "weight", "hub")
        if unsure.isEmpty():
            return materialise(met, "groups")
        theirs = sharing.join(unsure, "id", "left_semi").select("element").distinct()
        return materialise(met.unionByName(sharing.join(theirs, "element").select("element", "id", "n", F.lit(0).cast("long").alias("weight"), "hub")), "groups")

    def _arrays(self, wanted: DataFrame) -> DataFrame:
        """(id, elements): the sorted elements of the documents with the wanted ids."""
        width = self.width
        spark = self.texts.sparkSession
        place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
        bit = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))")
        marks = np.zeros(FILTER_BITS // 64, np.uint64)
        words = wanted.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(bit.alias("bits"))
        words = words.toArrow()  # bounded: FILTER_BITS bits
        marks[words.column("word").to_numpy().astype(np.int64)] = words.column("bits").to_numpy().view(np.uint64)
        marks = spark.sparkContext.broadcast(marks)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                keep = pa.array((marks.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
                batch = batch.filter(keep)
                for part in slices([batch], SLICE):
                    sets = element_sets(_blobs(part.column(1)), width)
                    wide = [signature(s) for s in sets]
                    yield _rows(id=part.column(0), elements=[s.tobytes() for s in sets], short=[np.bitwise_xor.reduce(w.reshape(-1, SHORT)) for w in wide], wide=wide)

        return materialise(self.texts.select("id", "text", place.alias("place")).mapInArrow(read, "id long, elements binary, short array<long>, wide array<long>").join(wanted, "id", "left_semi").where("length(elements) > 0"), "arrays")

    def _near(self, pairs: DataFrame, closest: bool) -> DataFrame:
        """Pairs (a, b) whose signatures allow a link; of each b only its closest, if asked."""
        num, den = self.num, self.den
        side = lambda k: self.classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        fits = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
                far = np.array([differing(p, q) for p, q in zip(x, y)], np.int64)
                both = np.array(n, np.int64) + np.array(m, np.int64)
                # overlap <= (both - far) / 2, union = both - overlap
                keep = (both - far) * den >= (both + far) * num
                yield _rows(a=np.array(a, np.int64)[keep], b=np.array(b, np.int64)[keep], far=far[keep])

        sides = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
        kept = sides.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, far long")
        if closest:
            kept = kept.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("best.a", "b")
        return materialise(kept.select("a", "b"), "near")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets, intersected, reach the threshold."""
        num, den, arrays = self.num, self.den, self.arrays

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(same * den >= num * (len(x) + len(y) - same))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        side = lambda k: arrays.select(F.col("id").alias(k), F.col("elements").alias(f"set_{k}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(meet, "a long, b long")
        return materialise(met.distinct(), "linked")

    @staticmethod
    def _mixed(named: DataFrame, *more) -> DataFrame:
        """The keys whose members are of several components."""
        return named.groupBy("element").agg(F.min("part").alias("low"), F.max("part").alias("high"), *more).where("low < high")

    @staticmethod
    def _across(named: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components: b with its group's hub, those of the hub's component with the next hub."""
        best = lambda name: F.max_by(F.struct("id", "part"), F.struct("weight", -F.col("id"))).alias(name)
        first = named.join(named.groupBy("element").agg(best("hub")), "element")
        others = first.where("part <> hub.part")
        second = first.join(others.groupBy("element").agg(best("next")), "element").where("part = hub.part")
        return others.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).unionByName(second.select(F.col("next.id").alias("a"), F.col("id").alias("b")))

    def links(self) -> DataFrame:
        """Links (a, b) between class representatives whose components are those of all links."""
        groups, found, tested = self._groups(), None, None
        for turn in range(ROUNDS):
            pairs = groups.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")) if turn == 0 else self._across(named)
            pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
            near = self._near(pairs, closest=True)
            linked = self._linked(near)
            if turn and linked.isEmpty():
                break
            both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
            tested = both if tested is None else tested.unionByName(both)
            found = linked if found is None else found.unionByName(linked)
            labels = components(found)
            named = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("element", "id", "n", "weight", F.coalesce("label", "id").alias("part"))
            named = materialise(named.join(self._mixed(named).select("element"), "element"), "named")
        # a key counts where it brings components together; of keys with the same members one does
        members = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"m{k}") for k in (1, 2)]
        mixed = self._mixed(named, F.count("*").alias("size"), *members)
        once = mixed.groupBy("m1", "m2", "size").agg(F.min("element").alias("element")).select("element")
        signs = self.arrays.groupBy("id").agg(F.first("short").alias("short"), F.first("wide").alias("wide"))
        rest = materialise(named.join(once, "element").join(signs, "id"), "rest")
        if rest.isEmpty():
            return found
        one = rest.select("element", F.col("id").alias("a"), F.col("n").alias("p"), F.col("part").alias("part_a"), F.col("short").alias("x"), F.col("wide").alias("xx"))
        two = rest.select("element", F.col("id").alias("b"), F.col("n").alias("q"), F.col("part").alias("part_b"), F.col("short").alias("y"), F.col("wide").alias("yy"))
        # signatures are compared inside the join, the short ones first: a pair too far apart is never made
        near = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(SHORT))
        may = f"* {self.den + self.num} <= (p + q) * {self.den - self.num}"
        fits = F.expr(f"part_a < part_b and least(p, q) * {self.den} >= greatest(p, q) * {self.num} and ({near}) {may} and ({far_sql('xx', 'yy')}) {may}")
        more = one.join(two, "element").where(fits).select("a", "b").distinct()
        return found.unionByName(self._linked(self._near(more, closest=False)))

    def members(self) -> DataFrame:
        """(id, n_shingles, component_id, digest) for every row; a text without words is alone with size 0.

        A row with a null id is linked with nothing: its component is null. digest tells rows that
        share an id apart by their text.
        """
        labels = components(self.links()).withColumnRenamed("node", "rep")
        rep = self.classes.select("mark", "rep").join(labels, "rep", "left").select("mark", F.coalesce("label", "rep").alias("component_id"))
        some = self.sets.where("n > 0 and id is not null").join(rep, "mark").select("id", F.col("n").alias("n_shingles"), "component_id", "digest")
        none = self.sets.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "digest")
        return some.unionByName(none).withColumnRenamed("id", self.id_col)


def by_two(rows: DataFrame, *more) -> DataFrame:
    """(element, hub, n_ids) of the elements that two ids have at least; hub is the smallest."""
    return rows.groupBy("element").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("n_ids"), *more).where("hub < top").drop("top")


def _rows(**columns) -> pa.RecordBatch:
    """A batch with the given columns; `_read` needs those it leaves out as nulls."""
    out = {k: v if isinstance(v, pa.Array) else pa.array(v, _TYPES.get(k)) for k, v in columns.items()}
    if "mark" in out or set(out) == {"element", "n"}:
        n = len(next(iter(out.values())))
        out = {k: out.get(k, pa.nulls(n, _TYPES[k])) for k in ("id", "n", "mark", "bits", "digest", "element")}
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


_TYPES = {"id": pa.int64(), "n": pa.int64(), "mark": pa.binary(), "bits": pa.binary(), "digest": pa.int64(), "short": pa.list_(pa.int64()), "wide": pa.list_(pa.int64()), "element": pa.int64(), "elements": pa.binary()}
