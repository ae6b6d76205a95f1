"""Reachability over dependency edges: src depends on dst.

Where every node has one way on, or one way in, paths double: a pointer leads 2, 4, 8, ...
steps ahead, and the number of rounds is the logarithm of the depth. So it is where all pairs
of any graph are asked for, because pairs found so far are joined with each other. Only the
surroundings of given roots in a graph with branches both ways are explored hop by hop: there
long paths would need pairs that nobody asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.plans.durable import durable, stored
from opsloom.plans.sizing import small_side

# Rounds after which the pairs found so far are written as one table again.
COMPACT_ROUNDS = 8


def steps(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(from, to): each direct step once, loops and unknown ends left out, written down."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    known = edges.where("src is not null and dst is not null and src <> dst")
    return durable(known.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct())


def most_per(step: DataFrame, end: str) -> int:
    """The most steps that share their ``end``."""
    counts = step.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def closure(edges: DataFrame, roots: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """All (root, node) pairs with a path from root to node, the root itself left out.

    A round keeps only pairs that were not known, so a cycle ends it. Rounds are written
    down, not held by executors.
    """
    step = steps(edges, reverse)
    wanted = None
    if roots is not None:
        wanted = durable(roots.select(F.col(roots.columns[0]).alias("root")).distinct())
    start = step.select(F.col("from").alias("root"), F.col("to").alias("node"))
    if wanted is not None:
        start = start.join(wanted, "root", "left_semi")
    if most_per(step, "from") <= 1:
        pairs = grown(start, pointers_ahead(step))
    elif most_per(step, "to") <= 1:
        pairs = grown(start, pointers_back(step))
    elif wanted is None:
        pairs = grown(start, pairs_joined)
    else:
        pairs = grown(durable(start), hops(step))
    return pairs.where("root <> node")


def grown(pairs: DataFrame, ahead) -> DataFrame:
    """``pairs`` and what ``ahead(reached, last found)`` adds, until it adds nothing."""
    reached = found = pairs
    rounds = 0
    while True:
        found = durable(ahead(reached, found).distinct().join(reached, ["root", "node"], "left_anti"))
        if found.isEmpty():
            return reached
        reached = reached.unionByName(found)
        rounds += 1
        if rounds % COMPACT_ROUNDS == 0:
            reached = durable(reached)


def doubled(jump: DataFrame) -> DataFrame:
    """Pointers twice as long, of nodes that have (from, to) pointers, one each."""
    on = jump.select(F.col("from").alias("to"), F.col("to").alias("further"))
    return stored(jump.join(on, "to").select("from", F.col("further").alias("to")), "jump")


def pointers_ahead(step: DataFrame):
    """Every node has one step on: what lies up to 2n steps ahead is n steps beyond what lies up to n ahead."""
    jump = step

    def ahead(reached: DataFrame, _) -> DataFrame:
        nonlocal jump
        further = reached.join(jump, F.col("node") == F.col("from")).select("root", F.col("to").alias("node"))
        jump = doubled(jump)
        return further

    return ahead


def pointers_back(step: DataFrame):
    """Every node has one step in: a root of the node n steps back is a root of the node itself."""
    jump = step.select(F.col("to").alias("from"), F.col("from").alias("to"))

    def ahead(reached: DataFrame, _) -> DataFrame:
        nonlocal jump
        further = reached.join(jump, F.col("node") == F.col("to")).select("root", F.col("from").alias("node"))
        jump = doubled(jump)
        return further

    return ahead


def pairs_joined(reached: DataFrame, found: DataFrame) -> DataFrame:
    """The last round's pairs, the longest, continued by all pairs: path lengths double."""
    on = reached.select(F.col("root").alias("node"), F.col("node").alias("further"))
    return found.join(on, "node").select("root", F.col("further").alias("node"))


def hops(step: DataFrame):
    hop = small_side(step)

    def ahead(_, found: DataFrame) -> DataFrame:
        return found.join(hop, F.col("node") == F.col("from")).select("root", F.col("to").alias("node"))

    return ahead


def dependent_counts(edges: DataFrame) -> DataFrame:
    """(node, dependents): how many nodes depend on each node that any depends on.

    Where each node depends on at most one other no pair is written: a node's count is a sum
    over the tree below it, doubled in depth each round, and a cycle counts as one node.
    """
    step = steps(edges)
    if most_per(step, "from") > 1:
        return fan_in(closure(edges))
    cycles = on_cycles(step)
    name = F.coalesce("cycle", "node").alias("name")
    nodes = step.select(F.col("from").alias("node")).unionByName(step.select(F.col("to").alias("node"))).distinct()
    named = durable(nodes.join(cycles, "node", "left").select("node", name))
    # The steps between cycles and other nodes: a forest. Each node's own weight is its size.
    up = step.join(named.select(F.col("node").alias("from"), F.col("name").alias("a")), "from")
    up = up.join(named.select(F.col("node").alias("to"), F.col("name").alias("b")), "to").where("a <> b")
    jump = durable(up.select(F.col("a").alias("from"), F.col("b").alias("to")).distinct())
    below = durable(named.groupBy("name").agg(F.count(F.lit(1)).alias("weight")))
    while not jump.isEmpty():
        # Nodes less than 2n steps below are those less than n below, and those that far below
        # the nodes exactly n below.
        more = jump.join(below, F.col("from") == F.col("name")).groupBy("to").agg(F.sum("weight").alias("more"))
        weight = (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")
        below = stored(below.join(more, F.col("name") == F.col("to"), "left").select("name", weight), "below")
        jump = doubled(jump)
    counts = named.join(below, "name").select("node", (F.col("weight") - 1).alias("dependents"))
    return counts.where("dependents > 0")


def on_cycles(step: DataFrame) -> DataFrame:
    """(node, cycle): the nodes on a cycle with its smallest node, where each node has one step on.

    A pointer as long as there are nodes ends on a cycle, and every node of a cycle is the
    end of one. The smallest node on the way round is found while the pointers double.
    """
    jump = durable(step.withColumn("least", F.least("from", "to")))
    length, nodes = 1, jump.count()
    while length < nodes and not jump.isEmpty():
        on = jump.select(F.col("from").alias("to"), F.col("to").alias("further"), F.col("least").alias("then"))
        jump = stored(
            jump.join(on, "to").select("from", F.col("further").alias("to"), F.least("least", "then").alias("least")), "jump"
        )
        length *= 2
    ends = jump.select(F.col("to").alias("from")).distinct()
    return jump.join(ends, "from").select(F.col("from").alias("node"), F.col("least").alias("cycle"))


def dependencies(edges: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Everything a service needs; a service without edges has no rows."""
    return closure(edges, services).select(
        F.col("root").alias("service"), F.col("node").alias("dependency")
    )


def blast_radius(edges: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Everything that fails with a service."""
    return closure(edges, services, reverse=True).select(
        F.col("root").alias("service"), F.col("node").alias("impacted")
    )


def fan_in(pairs: DataFrame) -> DataFrame:
    """How many nodes depend on each node: the single points of failure come first."""
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("dependents"))


def neighbours(edges: DataFrame, services: DataFrame, service: str = "service") -> DataFrame:
    """Direct dependencies with their relation."""
    return services.select(F.col(service).alias("src")).distinct().join(edges, "src").select(
        F.col("src").alias("service"), "dst", "relation"
    )


def _listed(names: Column) -> Column:
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n.cast("string"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def topology_text(services: DataFrame, needs: DataFrame, impacted: DataFrame) -> DataFrame:
    """One line per service; the names are sorted.

    ``needs`` and ``impacted`` are the outputs of :func:`dependencies` and :func:`blast_radius`.
    """
    a = needs.groupBy("service").agg(F.array_sort(F.collect_list("dependency")).alias("_needs"))
    b = impacted.groupBy("service").agg(F.array_sort(F.collect_list("impacted")).alias("_hit"))
    none = F.array().cast("array<string>")
    text = F.concat(
        F.lit("Service: "),
        F.col("service").cast("string"),
        F.lit(" | Dependencies: "),
        _listed(F.coalesce("_needs", none)),
        F.lit(" | Impacted If Failed: "),
        _listed(F.coalesce("_hit", none)),
    )
    return (
        services.select("service")
        .distinct()
        .join(a, "service", "left")
        .join(b, "service", "left")
        .select("service", text.alias("topology"))
    )
