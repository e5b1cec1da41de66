"""Near-duplicate groups: a Jaccard join on word n-gram sets by prefix trees.

A document's set holds its distinct n-word shingles. Shingles have one global order:
frequent ones last, in order of their count, the others by hash. Two documents link
when |A & B| / |A | B| reaches the threshold. With r = ceil(threshold * |A|) every
linked pair shares one of the first |A| - r + 1 shingles of either set, so only
documents that share such a shingle are ever compared.

1. Equal sets become one class. All later steps see one member of each.
2. Star rounds: for each shared shingle its documents are compared with one leader,
   not with each other. Verified pairs are joined into components. A shingle whose
   documents lie in one component is done; for the others another leader is tried.
3. What is left, documents of different components that share a shingle, is compared
   each with each, so no link between components is lost: as pairs where few share
   it, else block by block, in the tree of one block with the documents of another,
   of its own or a neighbouring band of set sizes; other sizes cannot link.

Comparing is done in prefix trees: the documents to be compared with one leader are
stored as paths of their ordered sets, common beginnings once. The walk carries the
overlap with the leader so far and turns back where it plus what may still come,
bounded by the remaining lengths, is less than the least overlap needed. It is done
twice: over the sets' beginnings, which are at hand and settle most pairs, and over
the whole sets of what is left, which are built again from the texts.

Shingles are 63-bit hashes; a shared hash of different shingles within one compared
pair is the only way to a wrong count. Components come from alternating large-star
and small-star steps over written edge tables. Nothing of the size of the corpus
reaches the driver: only the table of frequent shingles does, at most max_frequent
rows, and it affects the order, that is the cost, not the result.

Texts are lower-cased in A-Z only, words are runs of other than ASCII white space.
With fewer words than n the whole sequence is one shingle; without words (NULL or
empty text) the set is empty and links with nothing. Repeated rows and ids are
documents of their own; the id of a component is the smallest in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.batches import slices, words_of
from tallyframe.llm.text import sized_join
from tallyframe.storage import stage

FREQUENT = np.uint64(1 << 63)
#: Low bits of a shingle by which most that are not frequent are told at once.
SIEVE_BITS = 24


@dataclass(frozen=True)
class Settings:
    """Documents link when percent * |A or B| <= 100 * |A and B|."""

    words: int = 5
    percent: int = 80
    star_rounds: int = 2
    max_frequent: int = 1_000_000
    frequent_in_task: int = 2
    group_members: int = 64
    group_pairs: int = 32
    group_block: int = 256


# Shingles


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 63-bit hashes of its n-word shingles."""
    import xxhash

    codes, bounds, distinct = words_of(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]

    def mixed(words: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            out = (out ^ words[i : len(words) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(31)
        return out & ~FREQUENT

    every = mixed(h, n) if len(h) >= n else h
    none = np.zeros(0, np.uint64)
    return [np.unique(every[a : b - n + 1]) if b - a >= n else mixed(h[a:b], int(b - a)) if b > a else none for a, b in zip(bounds, bounds[1:])]


class Order:
    """The global order: frequent shingles last, by their ranks. frequent is sorted, places are its members' ranks."""

    def __init__(self, frequent: np.ndarray, places: np.ndarray):
        self.frequent, self.places = frequent, places
        self.mask = np.uint64((1 << SIEVE_BITS) - 1)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[frequent & self.mask] = True

    def of(self, found: np.ndarray) -> np.ndarray:
        """The set as numbers whose order is the global one."""
        maybe = np.flatnonzero(self.sieve[found & self.mask])
        if not len(maybe):
            return found
        k = np.searchsorted(self.frequent, found[maybe])
        k[k == len(self.frequent)] = 0
        hit = self.frequent[k] == found[maybe]
        found = found.copy()
        found[maybe[hit]] = FREQUENT | self.places[k[hit]]
        return np.sort(found)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


# Prefix trees


class Tree:
    """Sets as paths of their beginnings; a node holds a run of shingles and the least and most size of sets below."""

    __slots__ = ("run", "depth", "least", "most", "children", "members")

    def __init__(self, run: np.ndarray, depth: int):
        self.run, self.depth = run, depth
        self.least, self.most = 1 << 62, 0
        self.children: dict[int, Tree] = {}
        self.members: list[tuple[int, int]] = []

    def _hold(self, key: int, size: int) -> None:
        self.least, self.most = min(self.least, size), max(self.most, size)

    def add(self, key: int, found: np.ndarray, size: int) -> None:
        """found: the first shingles, in order, of a set of that size; all of them if it is as long."""
        node, at = self, 0
        while True:
            node._hold(key, size)
            if at == len(found):
                node.members.append((key, size))
                return
            child = node.children.get(int(found[at]))
            if child is None:
                child = node.children[int(found[at])] = Tree(found[at:], at)
                child._hold(key, size)
                child.members.append((key, size))
                return
            rest = found[at : at + len(child.run)]
            differ = np.flatnonzero(child.run[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.run):
                upper = Tree(child.run[:same], at)
                upper.least, upper.most = child.least, child.most
                upper.children[int(child.run[same])] = child
                child.run, child.depth = child.run[same:], at + same
                node.children[int(found[at])] = upper
                child = upper
            node, at = child, at + same

    def below(self) -> Iterator[tuple[int, int]]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield from node.members
            stack += node.children.values()

    def linked(self, probe: np.ndarray, size: int, percent: int) -> list[int]:
        """Keys of the sets that link with the probe, as far as the beginnings tell; of whole sets exactly those."""
        if not len(probe):
            return []
        found, stack = [], [(c, 0) for c in self.children.values()]
        while stack:
            node, overlap = stack.pop()
            # shingles beyond the probe's last one are neither known to be in its set nor not to be
            known = node.run[: int(np.searchsorted(node.run, probe[-1], "right"))]
            if len(known):
                k = np.searchsorted(probe, known)
                overlap += int((probe[k] == known).sum())
            seen = node.depth + len(known)
            passed = int(np.searchsorted(probe, node.run[-1], "right"))
            if overlap + min(size - passed, node.most - seen) < needed(size, node.least, percent):
                continue
            if len(known) < len(node.run):
                found += [key for key, n in node.below() if overlap + min(size - passed, n - seen) >= needed(size, n, percent)]
                continue
            found += [key for key, n in node.members if overlap + min(size - passed, n - seen) >= needed(size, n, percent)]
            stack += [(c, overlap) for c in node.children.values()]
        return found


# Components


def components(edges: DataFrame) -> DataFrame:
    """node, root for every end of an edge (a, b); the root is the smallest node of the component."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour is tied to the smallest one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        # small star: smaller neighbours, and the node, are tied to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = stage(small, "small-star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).collect()[0]
        if now == state:
            break
        state = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())


# The join


def _frequent(docs: DataFrame, settings: Settings, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some task's documents repeat, most frequent last: their sorted hashes and their ranks."""
    n, least = settings.words, settings.frequent_in_task

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = times >= least
            held.clear()
            size = 0
            yield pa.RecordBatch.from_arrays([pa.array(found[some].astype(np.int64)), pa.array(times[some].astype(np.int64))], ["s", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                for found in shingle_sets(part.column(0), n):
                    held.append(found)
                    size += len(found)
                if size > 2_000_000:
                    yield from flush()
        yield from flush()

    counted = docs.select(F.col(text).alias("t")).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "s").limit(settings.max_frequent).toArrow()
    s = top.column("s").to_numpy().astype(np.uint64)
    ranks = np.arange(len(s), 0, -1).astype(np.uint64)
    order = np.argsort(s)
    return s[order], ranks[order]


def _key(doc_id: str, text: str) -> Column:
    """Tells rows apart up to full equality of id and text, in 128 bits."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("x"), F.xxhash64(F.lit("key"), F.col(text), F.col(doc_id)).alias("y"))


def _grouped(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """row, key, doc_id, n, class, class_id, root (tells components apart), component_id: one row per row of docs."""
    spark, n, percent = docs.sparkSession, settings.words, settings.percent
    shared = spark.sparkContext.broadcast(_frequent(docs, settings, text))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = Order(*shared.value)
        for batch in batches:
            for part in slices(batch, 2):
                sizes, signs, prefixes = [], [], []
                for found in map(order.of, shingle_sets(part.column(2), n)):
                    sizes.append(len(found))
                    signs.append(xxhash.xxh3_128_digest(found.tobytes()))
                    prefixes.append(found[: prefix_length(len(found), percent)].astype(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), lists], ["doc_id", "key", "n", "sign", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("t"))
    rows = rows.mapInArrow(prepare, f"doc_id {kind}, key struct<x:long,y:long>, n long, sign binary, prefix array<long>")
    sets = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sets")

    classes = stage(sets.filter("n > 0").groupBy("sign").agg(F.min("row").alias("class"), F.min("doc_id").alias("class_id")), "classes")
    member = stage(sets.drop("prefix").join(classes, "sign", "left"), "members")
    repeats = stage(member.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", F.lit(True).alias("repeated")), "repeats")
    begun = _of_classes(sets, member.filter("row <> class").select("row"))
    spread = begun.select("class", "n", F.explode("found").alias("s"))
    shared_by = stage(spread.groupBy("s").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("s"), "shared-shingles")
    occurs = stage(spread.join(shared_by, "s"), "occurrences")
    # of an original and its edited copies the original shares most of what it has: it makes the best leader
    known = occurs.groupBy("class").agg((-F.count(F.lit(1)) / F.max("n")).alias("alone"))
    # of shingles that the very same documents share one is enough
    same = occurs.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("low"), F.max("class").alias("high"), F.bit_xor(F.xxhash64("class")).alias("x"))
    same = stage(same.groupBy("k", "low", "high", "x").agg(F.min("s").alias("s")).select("s"), "shared-shingles")
    occurs = stage(sized_join(occurs, same, "s", "inner").join(known, "class"), "occurrences")

    whole: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link, as edges (a, b)."""
        near = stage(_compared(pairs, begun, settings), "near-pairs").select(F.col("a").alias("lead"), F.col("b").alias("class"))
        wanted = near.select("class").unionByName(near.select(F.col("lead").alias("class"))).distinct()
        for w in whole:
            wanted = wanted.join(w.select("class"), "class", "left_anti")
        wanted = sized_join(member.filter("row = class").select("class", "key", "sign"), stage(wanted, "wanted"), "class", "left_semi")
        wanted = stage(sized_join(wanted, repeats, "key", "left"), "wanted")
        whole.append(_whole_sets(docs, wanted, settings, doc_id, text, shared))
        return stage(_compared(near, reduce(DataFrame.unionByName, whole), settings), "links")

    links, tested, roots = None, None, None
    for turn in range(settings.star_rounds):
        pairs = _star_pairs(occurs, roots, percent, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["lead", "class"], "left_anti")
        pairs = stage(pairs, "star-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = verified(pairs)
        links = found if links is None else links.unionByName(found)
        roots = stage(components(links), "roots")
    left = stage(_open(occurs, roots), "open")
    sizes = stage(left.groupBy("s").agg(F.count(F.lit(1)).alias("k")), "group-sizes")
    few = left.join(sizes.filter(F.col("k") <= settings.group_pairs), "s")
    one = few.select("s", F.col("class").alias("lead"), F.col("n").alias("m"), F.col("root").alias("other"))
    rest = one.join(few.drop("k"), "s").filter((F.col("other") != F.col("root")) & (F.col("lead") < F.col("class")) & _sizes_fit(percent)).select("lead", "class").distinct()
    many = left.join(sizes.filter(F.col("k") > settings.group_pairs), "s")
    rest = rest.unionByName(_group_pairs(many, begun, settings)).distinct()
    if tested is not None:
        rest = rest.join(tested, ["lead", "class"], "left_anti")
    found = verified(stage(rest, "rest-pairs"))
    if found.limit(1).count():
        roots = stage(components(found if links is None else links.unionByName(found)), "roots")

    named = member.select("row", "key", "doc_id", "n", "class", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    # a document without shingles is a component of its own
    alone = F.coalesce("class", -F.col("row") - 1)
    if roots is None:
        return named.withColumns({"root": alone, "component_id": F.col("class_id")})
    # only classes with links need a name other than their own
    linked = stage(sized_join(classes.select("class", "class_id"), roots.withColumnRenamed("node", "class"), "class", "inner"), "linked")
    lowest = linked.groupBy("root").agg(F.min("class_id").alias("component_id"))
    linked = stage(sized_join(linked.select("class", "root"), stage(lowest, "lowest"), "root", "inner"), "component-names")
    found = sized_join(named, linked, "class", "left")
    return found.withColumns({"component_id": F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("component_id")), "root": F.coalesce("root", alone)})


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id; one row per row of docs."""
    return _grouped(docs, settings, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id (NULL first, then by key); rows without shingles all stay.

    Of rows alike in id and text one stays. Columns pass through, whatever their names.
    """
    found = stage(_grouped(docs, settings, doc_id, text), "grouped")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"), F.max("n").alias("n"))
    copies = found.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    kept = kept.groupBy("key").agg(F.max("n").alias("n")).join(copies, "key", "left").select("key", ((F.col("n") > 0) & F.col("copies").isNotNull()).alias("repeated"))
    out = docs.select(_key(doc_id, text).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = sized_join(out, stage(kept, "kept"), "key", "inner")
    # only rows that are alike in id and text need a shuffle to leave one of them
    return out.filter("not repeated").select("row.*").unionByName(out.filter("repeated").dropDuplicates(["key"]).select("row.*"))


def _of_classes(sets: DataFrame, others: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """class, n, found: the first shingles of a member of each class. others: the rows that are not it, sent to all tasks if few."""
    few = others.limit(limit + 1).count() <= limit
    found = sets.filter("n > 0").join(F.broadcast(others) if few else others, "row", "left_anti").select(F.col("row").alias("class"), "n", F.col("prefix").alias("found"))
    return found if few else stage(found, "class-sets")


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("m", "n") >= percent * F.greatest("m", "n")


def _with_roots(occurs: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return occurs.withColumn("root", F.col("class"))
    return sized_join(occurs, roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _open(occurs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Occurrences of shingles whose documents lie in different components."""
    own = _with_roots(occurs, roots)
    mixed = own.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    return own.join(mixed, "s")


def _group_pairs(many: DataFrame, begun: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (lead, class) of different components from shingles that many documents share, as far as the beginnings tell.

    A shingle's documents are dealt to blocks; each pair of blocks is a task's work, so no group has a bound.
    """
    percent = settings.percent
    # sets that link are of one size band or of neighbouring ones
    band = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    own = many.select("s", "class", "root", band.alias("band"))
    sizes = own.groupBy("s", "band").agg(F.ceil(F.count(F.lit(1)) / settings.group_block).cast("int").alias("blocks"))
    sizes = stage(sizes.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands")), "bands")
    own = sized_join(own, sizes, "s", "inner")
    blocks = lambda k: F.coalesce(F.try_element_at("bands", F.col("band") + k), F.lit(0))
    own = own.withColumn("block", F.pmod(F.xxhash64("class"), blocks(0)).cast("int"))
    at, none = F.struct("band", "block"), F.array().cast("array<struct<band:int,block:int>>")
    met = lambda k: F.when(blocks(k) > 0, F.transform(F.sequence(F.lit(1), blocks(k)), lambda j: F.struct((F.col("band") + k).alias("band"), (j - 1).alias("block")))).otherwise(none)
    others = F.concat(met(-1), met(0), met(1))
    dealt = own.select("s", "class", "root", at.alias("at"), F.explode(others).alias("with_")).select("s", "class", "root", "at", F.least("at", "with_").alias("i"), F.greatest("at", "with_").alias("j"))
    # comparing takes longer than its few bytes tell: many parts
    parts = 4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(dealt, "blocks").join(begun, "class").select("s", "i", "j", "class", "root", "at", "n", "found").repartition(parts, "s", "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("found").chunk(0)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.uint64)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("class", "root", "at", "n")), strict=True))
        low, alike = table.column("i")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        tree, root_of = Tree(flat[:0], 0), {c: r for c, r, _, _ in rows}
        for i, (c, _, block, n) in enumerate(rows):
            if block == low:
                tree.add(c, flat[ends[i] : ends[i + 1]], n)
        hits = set()
        for i, (c, root, block, n) in enumerate(rows):
            if alike or block != low:
                hits |= {(min(c, other), max(c, other)) for other in tree.linked(flat[ends[i] : ends[i + 1]], n, percent) if root_of[other] != root}
        return pa.table({"lead": pa.array([a for a, _ in hits], pa.int64()), "class": pa.array([b for _, b in hits], pa.int64())})

    return dealt.groupBy("s", "i", "j").applyInArrow(compare, "lead long, class long")


def _star_pairs(occurs: DataFrame, roots: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """Each shingle's documents beside its leader of this turn, where they are not in one component yet."""
    own = _with_roots(occurs, None) if roots is None else stage(_open(occurs, roots), "open")
    choice = F.struct("alone", "class") if turn == 0 else F.struct(F.xxhash64("root", F.lit(turn)), "alone", "class")
    lead = own.groupBy("s").agg(F.min_by(F.struct(F.col("class").alias("lead"), F.col("n").alias("m"), F.col("root").alias("other")), choice).alias("x")).select("s", "x.*")
    beside = own.join(lead, "s").filter((F.col("root") != F.col("other")) & _sizes_fit(percent))
    return beside.select(F.least("lead", "class").alias("a"), F.greatest("lead", "class").alias("b")).select(F.col("a").alias("lead"), F.col("b").alias("class")).distinct()


def _whole_sets(docs: DataFrame, wanted: DataFrame, settings: Settings, doc_id: str, text: str, shared) -> DataFrame:
    """class, n and its whole ordered set for the wanted (class, key, sign, repeated), built anew from their texts."""
    n = settings.words

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = Order(*shared.value)
        for batch in batches:
            for part in slices(batch, 3, 256):
                classes, repeats, sets = [], [], [np.zeros(0, np.uint64)]
                for c, sign, repeated, found in zip(*(x.to_pylist() for x in part.columns[:3]), map(order.of, shingle_sets(part.column(3), n)), strict=True):
                    if xxhash.xxh3_128_digest(found.tobytes()) == sign:
                        classes.append(c)
                        repeats.append(bool(repeated))
                        sets.append(found)
                sizes = [len(x) for x in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(repeats, pa.bool_()), pa.array(sizes[1:], pa.int64()), lists], ["class", "repeated", "n", "found"])

    texts = sized_join(docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("t")), wanted, "key", "inner").select("class", "sign", "repeated", "t")
    built = stage(texts.mapInArrow(build, "class long, repeated boolean, n long, found array<long>"), "whole-sets")
    # only documents that are alike in id and text need a shuffle to leave one of them
    return built.filter("not repeated").unionByName(built.filter("repeated").dropDuplicates(["class"])).drop("repeated")


def _compared(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (lead, class) that link, as far as the sets (class, n, found) tell, as edges (a, b)."""
    percent = settings.percent
    load = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(load, "lead").withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("k") / settings.group_members)))
    dealt = stage(dealt.select("lead", "part", "class"), "dealt")
    leads = dealt.select(F.col("lead").alias("id"), "lead", "part", F.lit(None).cast("long").alias("class")).distinct()
    roles = dealt.select(F.col("class").alias("id"), "lead", "part", "class").unionByName(leads)
    rows = sized_join(sets.withColumnRenamed("class", "id"), roles, "id", "inner")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("found").chunk(0)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.uint64)
        tree, probes = Tree(flat[:0], 0), []
        for i, (c, size) in enumerate(zip(table.column("class").to_pylist(), table.column("n").to_pylist(), strict=True)):
            found = flat[ends[i] : ends[i + 1]]
            if c is None:
                probes.append((found, size))
            else:
                tree.add(c, found, size)
        hits = [h for found, size in probes for h in tree.linked(found, size, percent)]
        return pa.table({"a": pa.array([table.column("lead")[0].as_py()] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return rows.select("lead", "part", "class", "n", "found").groupBy("lead", "part").applyInArrow(compare, "a long, b long")
