"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents of one length are interchangeable, so the problem is held as a table of
counts by length (at most `capacity` rows, whatever the corpus), and a solution as
patterns of lengths with the number of sequences that follow each. The algorithm
works on groups, not on items: crossover injects whole well-filled sequences of
one parent into the other, takes out what is then present twice, and puts displaced
documents back, longest first, with one or two that fill the sequence exactly, or,
where that takes fewer, best-fit after swaps for shorter ones that fill a sequence better. Islands, one Spark task each,
evolve populations of their own; after each epoch their elites migrate to the next
island in the ring. The search ends at a lower bound (total length / capacity, or one
for every document too long to share a sequence with another such), which exact fits
meet where short documents abound, or after epochs in which no island gains.

Placing the documents is distributed: each gets its rank among those of its length
(counted by length and hash bucket, so that a length that many documents have is
spread over all tasks), and the rank falls in one pattern's range.
"""

from __future__ import annotations

import json
import random
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.batches import slices
from tallyframe.llm.tokens import TEXTS, Encoder
from tallyframe.storage import stage

#: Pairs of displaced lengths are looked at where there are no more than these; it is a matter of time, not of the result's validity.
PAIR_SIZES = 200
Pattern = tuple[int, ...]
Solution = dict[Pattern, int]


@dataclass(frozen=True)
class Search:
    islands: int = 8
    population: int = 12
    generations: int = 40
    #: epochs without a gain of any island after which the search ends
    patience: int = 5
    elites: int = 2
    seed: int = 20


def best_fit(counts: dict[int, int], capacity: int, bins: Solution | None = None, order: list[int] | None = None) -> Solution:
    """Put counts[s] items of each size s into the fullest bins that take them, opening new ones as needed.

    Bins alike are filled together: the work depends on the number of sizes, not of items.
    """
    by_room: dict[int, Counter] = defaultdict(Counter)
    for p, n in (bins or {}).items():
        by_room[capacity - sum(p)][p] += n
    rooms = sorted(by_room)
    for s in order or sorted(counts, reverse=True):
        left = counts.get(s, 0)
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, p, n = capacity, (), left
            else:
                room = rooms[i]
                p, n = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            each = room // s
            full, rest = divmod(left, each)
            if full >= n:
                moved, rest = [(each, n)], 0
                left -= each * n
            else:
                moved = [(each, full)] * bool(full) + [(rest, 1)] * bool(rest)
                if (same := n - full - bool(rest)) and p:
                    moved.append((0, same))
                left = 0
            for k, m in moved:
                new, r = tuple(sorted(p + (s,) * k, reverse=True)), room - s * k
                if r not in by_room:
                    insort(rooms, r)
                by_room[r][new] += m
    out: Solution = {}
    for c in by_room.values():
        out.update(c)
    return {p: n for p, n in out.items() if p}


def bins_of(solution: Solution) -> int:
    return sum(solution.values())


def fitness(solution: Solution, capacity: int) -> float:
    """Mean squared fill: fewer bins first, then full ones beside empty ones."""
    return sum(n * (sum(p) / capacity) ** 2 for p, n in solution.items()) / max(1, bins_of(solution))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by items that exclude each other, for each length k below which items are left out of account."""
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in {s for s in counts if 2 * s <= capacity} | {0}:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = {s: n for s, n in counts.items() if capacity - k >= s > capacity / 2}
        small = sum(s * n for s, n in counts.items() if capacity / 2 >= s >= k)
        room = sum(large.values()) * capacity - sum(s * n for s, n in large.items())
        bound = max(bound, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return bound


def exact_fit(counts: dict[int, int], capacity: int) -> Solution:
    """Bins one after the other: the longest item, then one or two that fill the rest exactly, or the longest that fits and so on.

    Of two the one is as long as can be, so that short ones last. Bins alike are filled together. The sizes at hand
    are the bits of a number, what they leave of a bin those of another, so a shift finds all pairs at once.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    there, rests = sum(1 << s for s in left), sum(1 << (capacity - s) for s in left)
    out: Solution = defaultdict(int)

    def take(s: int, n: int) -> None:
        nonlocal there, rests
        left[s] -= n
        if not left[s]:
            there ^= 1 << s
            rests ^= 1 << (capacity - s)

    while there:
        p, room = (), capacity
        while (s := (there & ((2 << room) - 1)).bit_length() - 1) > 0:
            if p and s < room:
                pairs = there & (rests >> (capacity - room)) & ((1 << room) - 2)
                one = pairs.bit_length() - 1
                if pairs and (2 * one != room or left[one] > 1):
                    s = one
            p, room = (*p, s), room - s
            take(s, 1)
        need = Counter(p)
        if n := min(left[s] // k for s, k in need.items()):
            for s, k in need.items():
                take(s, k * n)
        out[p] += n + 1
    return dict(out)


def _swap(bins: Counter, free: dict[int, int], capacity: int) -> None:
    """Displaced items, one or two together, take the place of a shorter item of a bin, as far as this fills the bin better. Both are changed."""
    for p, n in sorted(bins.items(), key=lambda x: sum(x[0])):
        room = capacity - sum(p)
        if not room:
            continue
        sizes, best = sorted(s for s, k in free.items() if k), (0, None, ())
        for out in dict.fromkeys(p):
            most = out + room
            i = bisect_left(sizes, most + 1) - 1
            if i >= 0 and sizes[i] - out > best[0]:
                best = (sizes[i] - out, out, (sizes[i],))
            j = 0
            for a in reversed(sizes[: i + 1] if len(sizes) <= PAIR_SIZES else []):  # of pairs the fullest that fits
                while j < len(sizes) and sizes[j] + a <= most:
                    j += 1
                if j and sizes[j - 1] + a - out > best[0] and (sizes[j - 1] != a or free[a] > 1):
                    best = (sizes[j - 1] + a - out, out, (a, sizes[j - 1]))
        gain, out, new = best
        if gain:
            n = min([n, *(free[s] // new.count(s) for s in new)])
            rest = list(p)
            rest.remove(out)
            bins[p] -= n
            bins[tuple(sorted([*rest, *new], reverse=True))] += n
            for s in new:
                free[s] -= n
            free[out] = free.get(out, 0) + n


def _insert(keep: list[tuple[Pattern, int]], counts: dict[int, int], capacity: int) -> Solution:
    """As many of each listed bin as the items still free allow, and the other items in bins of their own or best-fit into them, whichever are fewer."""
    free, kept = dict(counts), Counter()
    for p, n in keep:
        need = Counter(p)
        n = min([n, *(free.get(s, 0) // k for s, k in need.items())])
        if n:
            kept[p] += n
            for s, k in need.items():
                free[s] -= k * n
    free = {s: n for s, n in free.items() if n}
    new, unfilled = exact_fit(free, capacity), {p: n for p, n in kept.items() if sum(p) < capacity}
    if unfilled:
        swapped = Counter(unfilled)
        _swap(swapped, free, capacity)
        other = best_fit({s: n for s, n in free.items() if n}, capacity, {p: n for p, n in swapped.items() if n})
        if bins_of(other) < bins_of(new) + bins_of(unfilled):
            kept, new = Counter({p: n for p, n in kept.items() if p not in unfilled}), other
    kept.update(new)
    return dict(kept)


def crossover(a: Solution, b: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Well-filled bins of a are injected into b; b's bins that hold items used twice fall away, and of the others some."""
    full = sorted(a.items(), key=lambda x: -sum(x[0]))
    cut, share = capacity - rng.choice((0, 0, 0, 1, 4, 16, 64, 256)), rng.choice((0.3, 0.5, 0.7, 0.9))
    injected = [(p, n if rng.random() < 0.7 else rng.randint(0, n)) for p, n in full if sum(p) >= cut and rng.random() < share]
    rest = sorted(((p, n) for p, n in b.items() if sum(p) >= cut and rng.random() < share), key=lambda x: (-sum(x[0]), rng.random()))
    return _insert([x for x in injected if x[1]] + rest, counts, capacity)


def mutate(a: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """The worse-filled bins and many others are dissolved."""
    cut, share = capacity - rng.choice((0, 0, 0, 1, 4, 16, 64, 256)), rng.choice((0.3, 0.5, 0.7, 0.9))
    full = sorted(a.items(), key=lambda x: -sum(x[0]))
    return _insert([(p, n if rng.random() < 0.7 else rng.randint(0, n)) for p, n in full if sum(p) >= cut and rng.random() < share], counts, capacity)


def rank(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then by fitness."""
    return -bins_of(solution), fitness(solution, capacity)


def evolve(counts: dict[int, int], capacity: int, start: list[Solution], search: Search, rng: random.Random, bound: int) -> list[Solution]:
    """One island's epoch; best first."""
    pop = list(start) or [exact_fit(counts, capacity)]
    while len(pop) < search.population:
        order = sorted(counts, key=lambda s: -s * rng.uniform(0.7, 1.3))
        pop.append(best_fit(counts, capacity, None, order))
    pop = sorted(((rank(x, capacity), i, x) for i, x in enumerate(pop)), reverse=True)
    for i in range(search.generations):
        if -pop[0][0][0] <= bound:
            break
        child = crossover(*(x for _, _, x in rng.sample(pop, 2)), counts, capacity, rng) if len(pop) > 1 and rng.random() < 0.5 else mutate(rng.choice(pop)[2], counts, capacity, rng)
        pop = sorted([*pop, (rank(child, capacity), search.population + i + len(start), child)], reverse=True)[: search.population]
    return [x for _, _, x in pop]


def pack_lengths(spark, counts: dict[int, int], capacity: int, search: Search = Search()) -> Solution:
    """The best solution that the islands find for a table of counts by length."""
    bound = lower_bound(counts, capacity)
    plain, better = best_fit(counts, capacity), lambda x: rank(x, capacity)
    best = max(exact_fit(counts, capacity), plain, key=better)
    if bins_of(best) <= bound or len(counts) < 2:
        return best
    elites: dict[int, list[Solution]] = {i: [best] for i in range(search.islands)}
    epoch, idle = 0, 0
    while idle < search.patience:
        seeds = {i: json.dumps([list(x.items()) for x in elites[i]]) for i in elites}

        def island(batches: Iterator[pa.RecordBatch], seeds=seeds, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    start = [{tuple(p): n for p, n in x} for x in json.loads(seeds[i])]
                    pop = evolve(counts, capacity, start, search, random.Random(f"{search.seed}/{epoch}/{i}"), bound)
                    found = json.dumps([list(x.items()) for x in pop[: search.population // 2]])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([found])], ["island", "found"])

        rows = spark.range(0, search.islands, 1, search.islands).mapInArrow(island, "island long, found string").collect()
        found = {r["island"]: [{tuple(p): n for p, n in x} for x in json.loads(r["found"])] for r in rows}
        champion = max((x for xs in found.values() for x in xs), key=better)
        epoch, idle = epoch + 1, 0 if bins_of(champion) < bins_of(best) else idle + 1
        best = max(best, champion, key=better)
        if bins_of(best) <= bound:
            break
        elites = {i: [*found[i], *found[(i - 1) % search.islands][: search.elites]] for i in found}
    return best


def slots(solution: Solution, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Items ordered by length and rank are the positions 0..N-1; from each start on, they go to sequence + k at offset."""
    first, at = {}, 0
    for s in sorted(counts):
        first[s] = at
        at += counts[s]
    taken, rows, base = dict(first), [], 0
    for p, n in sorted(solution.items()):
        offset = 0
        for s in p:
            rows.append((taken[s], base, offset))
            taken[s] += n
            offset += s
        base += n
    rows.sort()
    start, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return start, sequence, offset, first


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", search: Search = Search()) -> DataFrame:
    """items plus sequence_id and offset; lengths from 1 to capacity. Items is read several times: pass a written table.

    Rows alike are packed each for itself. Columns named sequence_id or offset are replaced, bucket_, rank_ and before_ dropped.
    """
    items = items.drop("sequence_id", "offset", "bucket_", "rank_", "before_")  # working names, too
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    if any(s is None or not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    solution = pack_lengths(items.sparkSession, counts, capacity, search)
    start, sequence, offset, first = slots(solution, counts)

    kinds = items.columns
    others = [F.col(f"`{c}`") for c in items.columns]
    buckets = max(64, sum(counts.values()) // 20_000)
    keyed = items.withColumn("bucket_", F.pmod(F.xxhash64(*others), F.lit(buckets)))
    per = keyed.groupBy(length, "bucket_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(length).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(length, "bucket_").orderBy(*others)) - 1
    ranked = keyed.withColumn("rank_", rank.cast("long")).join(per, [length, "bucket_"]).withColumn("rank_", F.col("rank_") + F.col("before_"))
    ranked = ranked.select(*others, "rank_")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array(sorted(first), np.int64)
        firsts = np.array([first[s] for s in sizes.tolist()], np.int64)
        for batch in batches:
            s = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            at = firsts[np.searchsorted(sizes, s)] + batch.column("rank_").to_numpy(zero_copy_only=False)
            k = np.searchsorted(start, at, "right") - 1
            columns = [*(batch.column(c) for c in kinds), pa.array(sequence[k] + at - start[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(columns, [*kinds, "sequence_id", "offset"])

    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append end_id, and cut those beyond capacity; the first piece takes the remainder.

    One row a piece: doc_id, piece, start, length, ids_crc32. NULL text is empty: a piece of the end id alone.
    """
    end, step = struct.pack("<I", end_id), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, TEXTS):
                rows = []
                for d, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    cuts = [0, *range(len(ids) % step or step, len(ids), step), len(ids)]
                    rows += [(d, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, doc_id: str = "doc_id", text: str = "text", search: Search = Search()) -> DataFrame:
    """pieces() of all documents with the sequence and offset of each."""
    return pack(stage(pieces(docs, capacity, vocabulary, end_id, doc_id, text), "pieces"), capacity, "length", search)
