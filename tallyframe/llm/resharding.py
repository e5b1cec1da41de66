"""Incremental resharding by minimum-cost flow.

Documents lie in old shards, each a folder of Parquet files. New shards get equal byte
capacities. A flow from old shard sizes to new capacities, free where a byte stays
in the shard of the same number and 1 a byte elsewhere, gives the transfers that
move the fewest bytes. Each old shard is a line of files, in stretches for the shards
that its bytes go to, its own one first. A file within one stretch stays where it is or
moves whole; only files on a border are divided, their documents dealt, longest first,
to the shard that lacks most. Files that stay are neither read nor written; moved and
divided ones are written into their new shards, then deleted from the old ones.

The flow's graph has old x new edges, and there are fewer divided files than old + new
shards, of at most docs_per_file documents each: those are dealt in one task. The driver
holds the totals of shards and the paths of the files that move, a document's place
comes from its file and its row there. No document is shuffled.

A document's size is its UTF-8 bytes plus 1; NULL text has size 1. Rows alike are placed
each for itself; one id that many rows have makes a large old shard, not a large new one.
An empty table has no files and gives no rows. Only id and text of the input are read.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.text import sized_join
from tallyframe.storage import fresh_path, stage


@dataclass(frozen=True)
class Layout:
    old_shards: int = 12
    new_shards: int = 16
    docs_per_file: int = 8192


@dataclass(frozen=True)
class Moves:
    """What a resharding did, in bytes and files."""

    planned_bytes: int  # the flow's
    moved_bytes: int  # of documents whose shard changed
    written_bytes: int  # of documents in files that were written
    written_files: int
    kept_files: int


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Units sent from each supply to each capacity at least total cost, by successive shortest augmenting paths.

    Capacities must add up to the supplies or more. Costs are not negative.
    """
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        # cheapest way from any supply with units left: nodes 0..n-1 are supplies, n.. are capacities
        best = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        queue, waiting = deque(i for i in range(n) if left[i]), set(range(n))
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            if x < n:
                steps = [(n + j, cost(x, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, x - n)) for i in range(n) if flow[i][x - n]]
            for y, c in steps:
                if best[x] + c < best[y]:
                    best[y], came[y] = best[x] + c, x
                    if y not in waiting:
                        waiting.add(y)
                        queue.append(y)
        end = min((j for j in range(m) if room[j]), key=lambda j: best[n + j])
        path = [n + end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        units = min([left[path[0]], room[end], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n)])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += units
            else:
                flow[b][a - n] -= units
        left[path[0]] -= units
        room[end] -= units
    return flow


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def write_shards(docs: DataFrame, layout: Layout = Layout(), folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write docs (doc_id, text, size) to folder, a directory a shard by a hash of the id; returns the folder."""
    folder = folder or fresh_path(docs.sparkSession, "shards")
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col(doc_id)), F.lit(layout.old_shards)).cast("int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _size(F.col(text)).alias("size"), shard.alias("shard"))
    rows.write.option("maxRecordsPerFile", layout.docs_per_file).partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, kind: str, *paths: str) -> DataFrame:
    """doc_id, text, size, shard, and path_ and row_: the file, and the place in it."""
    rows = spark.read.schema(f"doc_id {kind}, text string, size long, shard int").option("basePath", folder).parquet(*(paths or (folder,)))
    return rows.select("*", F.col("_metadata.file_path").alias("path_"), F.col("_metadata.row_index").alias("row_"))


def listed(rows: DataFrame, name: str) -> DataFrame:
    """shard, path_, bytes, n and the bytes and documents of the shard's files before it: one row a file."""
    per = rows.groupBy("shard", "path_").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("path_").rowsBetween(Window.unboundedPreceding, -1)
    return stage(per.withColumns({"begin": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "base": F.coalesce(F.sum("n").over(before), F.lit(0))}), name)


def stretches(flow: list[list[int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each old shard (first byte, end, shard that they go to), its own shard first."""
    found = {}
    for old, row in enumerate(flow):
        at, found[old] = 0, []
        for j in sorted(range(len(row)), key=lambda j: (j != old, j)):
            if row[j]:
                found[old].append((at, at + row[j], j))
                at += row[j]
    return found


def deal(rows: list[tuple[str, int, int]], wanted: dict[str, dict[int, int]]) -> list[int]:
    """A shard for each (file, place, size) of divided files. wanted: bytes of each file for each shard; what one file leaves open the next one makes up for."""
    to, lack = [0] * len(rows), dict.fromkeys((j for w in wanted.values() for j in w), 0)
    files: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        files.setdefault(r[0], []).append(i)
    for path in sorted(files):
        need = {j: n + lack[j] for j, n in wanted[path].items()}
        for i in sorted(files[path], key=lambda i: (-rows[i][2], rows[i][1])):
            to[i] = max(need, key=lambda j: (need[j], -j))
            need[to[i]] -= rows[i][2]
        lack |= need
    return to


def reshard(spark: SparkSession, folder: str, kind: str = "long", new_shards: int = 16) -> tuple[DataFrame, Moves]:
    """Deal the documents of folder (see write_shards; ids of that type) to new_shards shards of near equal bytes, in place.

    Returns doc_id, text, size, slot (gapless from 0 within a shard), shard, and what was done.
    """
    old = listed(read_shards(spark, folder, kind), "old-files")
    sums = {r["shard"]: r["bytes"] for r in old.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [sums.get(i, 0) for i in range(max([new_shards, *(i + 1 for i in sums)]))]
    total = sum(supply)
    flow = min_cost_flow(supply, [total // new_shards + (j < total % new_shards) for j in range(new_shards)], lambda i, j: 0 if i == j else 1)

    lines = spark.createDataFrame([(i, x) for i, x in stretches(flow).items()], "shard int, stretches array<struct<first:long,end:long,to:int>>")
    plan = old.join(F.broadcast(lines), "shard")
    inside = F.filter("stretches", lambda x: (x["end"] > F.col("begin")) & (x["first"] < F.col("begin") + F.col("bytes")))
    plan = stage(plan.withColumn("inside", inside).withColumn("to", F.when(F.size("inside") == 1, F.get("inside", F.lit(0))["to"])).drop("stretches"), "reshard-plan")
    whole = plan.filter("to <> shard")
    moved = {r["path_"]: r["bytes"] for r in whole.select("path_", "bytes").collect()}
    divided = {r["path_"]: r for r in plan.filter("to IS NULL").collect()}
    wanted = {p: {x["to"]: min(x["end"], r["begin"] + r["bytes"]) - max(x["first"], r["begin"]) for x in r["inside"]} for p, r in divided.items()}

    left, columns, changed = [], ("doc_id", "text", "size", "shard"), sum(moved.values())
    if moved:
        rows = sized_join(read_shards(spark, folder, kind, *moved).drop("shard"), whole.select("path_", F.col("to").alias("shard")), "path_", "inner")
        left.append(rows.select(*columns))
    if divided:

        def run(group: pa.Table) -> pa.Table:
            rows = list(zip(*(group.column(c).to_pylist() for c in ("path_", "row_", "size")), strict=True))
            return pa.table({"path_": group.column("path_"), "row_": group.column("row_"), "size": group.column("size"), "was": group.column("shard"), "shard": pa.array(deal(rows, wanted), pa.int32())})

        on_border = read_shards(spark, folder, kind, *divided)
        to = stage(on_border.select("path_", "row_", "size", "shard").groupBy().applyInArrow(run, "path_ string, row_ long, size long, was int, shard int"), "reshard-border")
        changed += to.filter("was <> shard").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        left.append(sized_join(on_border.drop("shard", "size"), to.drop("was"), ["path_", "row_"], "inner").select(*columns))
    kept = plan.count() - len(moved) - len(divided)
    for rows in left:
        rows.write.mode("append").partitionBy("shard").parquet(folder)
    _delete(spark, [*moved, *divided])

    now = listed(read_shards(spark, folder, kind), "new-files")
    result = sized_join(read_shards(spark, folder, kind), now.select("path_", "base"), "path_", "inner")
    planned = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    done = Moves(planned, changed, sum(moved.values()) + sum(r["bytes"] for r in divided.values()), len(moved) + len(divided), kept)
    return result.select("doc_id", "text", "size", (F.col("base") + F.col("row_")).alias("slot"), "shard"), done


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Files whose documents have been written anew."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
