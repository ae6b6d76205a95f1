"""Resharding by minimum-cost flow.

The rows of each old shard are dealt into blocks by a hash of id, text and occurrence, so that
rows which repeat id and text spread like any others, and the blocks' bytes are summed.
Moving a byte costs one, leaving it where it is costs nothing: a minimum-cost flow from old
sizes to new capacities says how many bytes go from which shard to which, and blocks of about
those bytes are assigned. Only the shard sizes and block sizes come to the driver; their
number is a parameter. Files of shards that neither give nor take rows stay as they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import whole_text, written
from opsloom.plans.ranking import ordered_rank

SHARDS = 24
# Blocks of one old shard: the finer, the nearer the new shards come to their capacities.
BLOCKS = 2048
# Rows that repeat id and text which one task counts up in a go.
REPEATS = 1024
# Bytes that each row needs besides its text.
ROW_BYTES = 8


def min_cost_flow(supplies: list[int], demands: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest transport from supplies to demands (equal sums) by successive shortest paths.

    ``cost(i, j)`` is the price of one unit. Each round sends as much as possible along the
    cheapest residual path, found by Dijkstra's algorithm under potentials.
    """
    n, m = len(supplies), len(demands)
    source, sink = n + m, n + m + 1
    capacity: dict[tuple[int, int], int] = {}
    price: dict[tuple[int, int], int] = {}
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, units: int, each: int) -> None:
        capacity[a, b], capacity[b, a] = units, 0
        price[a, b], price[b, a] = each, -each
        arcs[a].append(b)
        arcs[b].append(a)

    for i in range(n):
        arc(source, i, supplies[i], 0)
        for j in range(m):
            arc(i, n + j, min(supplies[i], demands[j]), cost(i, j))
    for j in range(m):
        arc(n + j, sink, demands[j], 0)
    potential = [0] * (n + m + 2)
    while True:
        distance, parent = {source: 0}, {}
        queue = [(0, source)]
        while queue:
            far, a = heapq.heappop(queue)
            if far > distance[a]:
                continue
            for b in arcs[a]:
                to = far + price[a, b] + potential[a] - potential[b]
                if capacity[a, b] > 0 and to < distance.get(b, to + 1):
                    distance[b], parent[b] = to, a
                    heapq.heappush(queue, (to, b))
        if sink not in distance:
            break
        longest = max(distance.values())
        potential = [p + distance.get(v, longest) for v, p in enumerate(potential)]
        path, at = [], sink
        while at != source:
            path.append((parent[at], at))
            at = parent[at]
        units = min(capacity[e] for e in path)
        for a, b in path:
            capacity[a, b] -= units
            capacity[b, a] += units
    return {(i, j): capacity[n + j, i] for i in range(n) for j in range(m) if capacity[n + j, i]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign_blocks(blocks: dict[tuple[int, int], int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard, from the blocks' bytes.

    The flow gives each pair of shards its bytes; an old shard's blocks, largest first, go
    where most of those bytes are still open. Shards beyond the new ones give everything up.
    """
    sizes: dict[int, int] = {}
    for (old, _), size in blocks.items():
        sizes[old] = sizes.get(old, 0) + size
    olds = sorted(sizes)
    flow = min_cost_flow([sizes[o] for o in olds], capacities, lambda i, j: int(olds[i] != j))
    placed = {}
    for i, old in enumerate(olds):
        left = {j: f for (a, j), f in flow.items() if a == i} or {old % len(capacities): 0}
        # Home first among equals, so that a tie moves nothing.
        queue = [(-f, j != old, j) for j, f in left.items()]
        heapq.heapify(queue)
        for (_, block), size in sorted(
            ((k, v) for k, v in blocks.items() if k[0] == old), key=lambda x: (-x[1], x[0])
        ):
            open_bytes, away, j = heapq.heappop(queue)
            placed[old, block] = j
            heapq.heappush(queue, (open_bytes + size, away, j))
    return even_out(blocks, placed, capacities)


def even_out(blocks, placed, capacities):
    """Moves single blocks from the fullest to the emptiest shard while that brings them nearer.

    What block borders left over is at most a few blocks; moved blocks are taken before ones
    that are still at home.
    """
    load = [0] * len(capacities)
    inside: list[list] = [[] for _ in capacities]
    for key, shard in placed.items():
        load[shard] += blocks[key]
        heapq.heappush(inside[shard], (key[0] == shard, blocks[key], key))
    for _ in range(16 * len(capacities)):
        over = [a - b for a, b in zip(load, capacities, strict=True)]
        most, least = over.index(max(over)), over.index(min(over))
        gap = over[most] - over[least]
        fit = max((x for x in inside[most] if 0 < x[1] < gap), key=lambda x: (not x[0], -abs(gap / 2 - x[1])), default=None)
        if gap <= 1 or fit is None:
            break
        inside[most].remove(fit)
        key = fit[2]
        inside[least].append((key[0] == least, fit[1], key))
        placed[key] = least
        load[most] -= fit[1]
        load[least] += fit[1]
    return placed


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with an ``occurrence`` that tells equal rows apart: 0, 1, 2, ...

    Equal rows are counted, which combines them before they travel, and written out again;
    the copies of a row that repeats very often are written by many tasks.
    """
    kinds = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "shard-kinds")
    few = kinds.where(F.col("times") <= REPEATS).select(
        *rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("occurrence")
    )
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(REPEATS).cast("long")))
    parts = kinds.where(F.col("times") > REPEATS).select(*rows.columns, "times", first.alias("first"))
    last = F.least(F.col("first") + REPEATS, F.col("times")) - 1
    many = parts.repartition(*rows.columns, "first").select(
        *rows.columns, F.explode(F.sequence(F.col("first"), last)).alias("occurrence")
    )
    return few.unionByName(many)


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot: one row per row of ``docs``.

    ``old`` is a row's present shard, a small integer. Size is the text's UTF-8 bytes plus 8;
    null and empty texts have 8. ``capacities`` default to equal shares of all bytes. Slots
    count from 0 without gaps in each shard. Repeated rows are rows of their own; an empty
    table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(
        "doc_id",
        (F.octet_length(whole_text()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        old.cast("int").alias("old_shard"),
    )
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "occurrence"), F.lit(BLOCKS)).cast("int")
    rows = written(numbered(slim).withColumn("block", block), "shard-rows")
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    bytes_of = {(r["old_shard"], r["block"]): r["bytes"] for r in sums}
    placed = assign_blocks(bytes_of, capacities or equal_capacities(sum(bytes_of.values()), shards))
    rows_of = {(r["old_shard"], r["block"]): r["rows"] for r in sums}
    table, filled = [], [0] * shards
    for key in sorted(placed):
        shard = placed[key]
        table.append((*key, shard, filled[shard]))
        filled[shard] += rows_of[key]
    # One row for each block of each old shard: bounded by the two parameters.
    where = spark.createDataFrame(table, "old_shard int, block int, shard int, first long")
    order = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(where), ["old_shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "old_shard",
        "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"),
    )


def affected_shards(assignment: DataFrame) -> DataFrame:
    """shard, moved_in, moved_out: the shards whose files have to be written again."""
    moved = assignment.where("old_shard <> shard")
    both = moved.select("shard", F.lit(1).alias("moved_in"), F.lit(0).alias("moved_out")).unionByName(
        moved.select(F.col("old_shard").alias("shard"), F.lit(0).alias("moved_in"), F.lit(1).alias("moved_out"))
    )
    return both.groupBy("shard").agg(F.sum("moved_in").alias("moved_in"), F.sum("moved_out").alias("moved_out"))


IDENTITY = ["doc_id", "text_crc32", "size"]


def rewrite(docs: DataFrame, assignment: DataFrame, path: str, old: Column | None = None) -> None:
    """Writes the affected shards below ``path`` as ``shard=N``; other shards' files are not touched.

    Rows are found by id, text and occurrence, so ids may be null or repeat. ``old`` is a row's
    present shard as given to ``resharded``; it is needed where rows of several shards repeat id
    and text but differ in other columns. Affected shards that end without rows lose their folder.
    """
    spark = docs.sparkSession
    here = [] if old is None else ["old_shard"]
    keys = [*here, *IDENTITY]
    full = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c not in ("shard", "slot")]).alias("row"),
        *[old.cast("int").alias(c) for c in here],
        "doc_id",
        F.crc32(whole_text()).alias("text_crc32"),
        (F.octet_length(whole_text()) + ROW_BYTES).cast("long").alias("size"),
        F.rand(1).alias("drawn"),
    )
    counted = ordered_rank(full, keys, [F.col("drawn")], "occurrence")
    placed = ordered_rank(
        assignment.select(*dict.fromkeys(["old_shard", *keys]), "shard", "slot"),
        keys,
        [F.col("shard"), F.col("slot")],
        "occurrence",
    )
    affected = {r["shard"] for r in affected_shards(assignment).select("shard").collect()}
    filled = {r["shard"] for r in assignment.select("shard").distinct().collect()}
    same = " and ".join(f"d.{c} <=> p.{c}" for c in [*keys, "occurrence"])
    rows = (
        counted.alias("d")
        .join(placed.where(F.col("shard").isin(*affected)).alias("p"), F.expr(same))
        .select("d.row.*", "p.shard", "p.slot")
    )
    (
        written(rows, "rewritten")
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
    # A dynamic overwrite leaves folders that receive nothing.
    for shard in sorted(affected - filled):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
