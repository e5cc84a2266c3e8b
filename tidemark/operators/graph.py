"""Structure of the lineage graph: roles, degrees, levels, reachability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Rounds, materialise


def node_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source (nothing comes in), sink (nothing goes out) or intermediate."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")),
            )
        )
    )
    degrees = ends.groupBy("id").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    return (
        nodes.join(degrees, "id", "left")
        .select(
            "id",
            F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
            F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        )
        .withColumn(
            "role",
            F.when(F.col("in_degree") == 0, "source")
            .when(F.col("out_degree") == 0, "sink")
            .otherwise("intermediate"),
        )
    )


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per neighbour; a node without any has one row marked isolated.

    ``nodes`` holds all edge ends. Rows rather than lists, and no join for nodes that
    have neighbours: a hub with very many of them stays spread out as its edges are.
    """
    near = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("target").alias("id"), F.lit("upstream").alias("direction"), F.col("source").alias("neighbour")),
                F.struct(F.col("source").alias("id"), F.lit("downstream").alias("direction"), F.col("target").alias("neighbour")),
            )
        )
    )
    alone = nodes.select("id").join(near.select("id").distinct(), "id", "left_anti")
    return near.unionByName(
        alone.select("id", F.lit("isolated").alias("direction"), F.lit(None).cast("string").alias("neighbour"))
    )


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = edges.agg(F.count("*")).scalar()
    return nodes.agg(F.count("*").alias("nodes")).select("nodes", count.alias("edges"))


@dataclass(frozen=True)
class Condensed:
    """A graph with every cycle as one group: (id, group), edges between groups, and (id, level) of groups."""

    members: DataFrame
    edges: DataFrame
    layers: DataFrame


def condense(nodes: DataFrame, edges: DataFrame) -> Condensed:
    """Groups of nodes that reach each other, and their layers.

    Written in all: the edges once, and for every edge at most one count and for every
    node one row, however many layers there are.
    """
    pairs = materialise(edges.select("source", "target").distinct(), "level-edges")
    levelled = _peel(nodes.select("id"), pairs)
    left = materialise(nodes.select("id").join(levelled, "id", "left_anti"), "level-rest")
    if left.isEmpty():
        return Condensed(nodes.select("id", F.col("id").alias("group")), pairs, levelled)
    # Only nodes on cycles and behind them are left; cycles lie among these.
    inner = pairs.join(left.toDF("source"), "source", "left_semi").join(left.toDF("target"), "target", "left_semi")
    groups = _cycles(left, materialise(inner.select("source", "target"), "level-edges"))
    grouped = materialise(
        nodes.select("id").join(groups, "id", "left").select("id", F.coalesce("group", "id").alias("group")), "level-groups"
    )
    merged = (
        pairs.join(grouped.toDF("source", "s"), "source").join(grouped.toDF("target", "t"), "target")
        .where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()
    )
    merged = materialise(merged, "level-edges")
    return Condensed(grouped, merged, _peel(grouped.select(F.col("group").alias("id")).distinct(), merged))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node: the longest path to it when each cycle counts as one node.

    Nodes without incoming edges and cycles that nothing leads to have level 0; all
    nodes of a cycle share a level.
    """
    found = condense(nodes, edges)
    return found.members.join(found.layers.toDF("group", "level"), "group").select("id", "level")


def _peel(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, level) layer by layer: a node follows once all edges into it are used.

    A round counts the edges that leave its layer per target; the next layer are the
    targets whose counts add up to their incoming edges. Nodes on cycles and behind
    them never do and are left out.
    """
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["source"]
    incoming = materialise(pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("edges")), "level-incoming")
    used = Rounds(spark, "level-used", f"id {kind}, edges long")
    layers = Rounds(spark, "level-layers", f"id {kind}")
    layer = layers.add(ids.join(incoming, "id", "left_anti"))
    while not layer.isEmpty():
        now = used.add(
            pairs.join(layer.toDF("source"), "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("edges"))
        )
        sums = used.all().join(now.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("edges").alias("edges"))
        layer = layers.add(sums.join(incoming, ["id", "edges"]).select("id"))
    return layers.all().withColumnRenamed("round", "level")


def _least(ids: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """(id, least): the least node that reaches each node, itself included.

    Every node points to one of the nodes before it, and by pointer doubling learns the
    least on the whole way back, which ends on a ring of pointers, in rounds that grow with
    the logarithm of the number of nodes. Then rounds over all edges follow; what reaches
    one node of a ring reaches all nodes whose pointers end there, so it is theirs at once,
    however long the ring.
    """
    before = pairs.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("at"))
    start = ids.join(before, "id", "left").select("id", F.coalesce("at", "id").alias("at"))
    known = materialise(start.select("id", "at", F.least("id", "at").alias("least")), label)
    for _ in range(max(1, (known.count() - 1).bit_length())):
        ahead = known.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("ahead"))
        known = materialise(
            known.join(ahead, "at").select("id", F.col("next").alias("at"), F.least("least", "ahead").alias("least")), label
        )
    ends = known.select(F.col("at").alias("id"), F.lit(True).alias("on_ring")).distinct()
    rings = known.select(F.col("id").alias("at"), F.col("least").alias("ring"))
    known = materialise(
        known.join(rings, "at").join(ends, "id", "left")
        .select("id", "ring", "least", F.coalesce("on_ring", F.lit(False)).alias("on_ring"), F.lit(True).alias("moved")),
        label,
    )
    while not known.where("moved").isEmpty():
        told = (
            pairs.join(known.select(F.col("id").alias("source"), "least"), "source")
            .groupBy(F.col("target").alias("id")).agg(F.min("least").alias("told"))
        )
        step = known.join(told, "id", "left").withColumn("heard", F.least("least", "told"))
        shared = step.where("on_ring").groupBy("ring").agg(F.min("heard").alias("shared"))
        best = F.least("heard", "shared")
        known = materialise(
            step.join(shared, "ring", "left").select("id", "ring", best.alias("least"), "on_ring", (best < F.col("least")).alias("moved")), label
        )
    return known.select("id", "least")


def _cycles(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group) of the nodes on cycles, a group per set of nodes that reach each other.

    Nodes that lead to no cycle are peeled off first. Every node then learns the least
    node that reaches it, and among those that learned the same one, the least it
    reaches: where both are the same, it lies on cycles with that node. Groups found are
    taken out and the rest goes on.
    """
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["source"]
    found = Rounds(spark, "cycles", f"id {kind}, group {kind}")
    while True:
        backwards = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
        ids = materialise(ids.join(_peel(ids, backwards), "id", "left_anti"), "cycle-nodes")
        if ids.isEmpty():
            return found.all().drop("round") if found.number >= 0 else spark.createDataFrame([], f"id {kind}, group {kind}")
        pairs = materialise(
            pairs.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi"), "cycle-edges"
        )
        colour = _least(ids, pairs, "cycle-colours")
        same = pairs.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target").where("a = b")
        back = materialise(same.select(F.col("target").alias("source"), F.col("source").alias("target")), "cycle-same")
        reached = _least(ids, back, "cycle-reached").withColumnRenamed("least", "group")
        new = found.add(reached.join(colour, "id").where(F.col("group") == F.col("least")).select("id", "group"))
        ids = materialise(ids.join(new, "id", "left_anti"), "cycle-nodes")
        pairs = materialise(
            pairs.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi"), "cycle-edges"
        )


def level_sizes(levelled: DataFrame) -> DataFrame:
    return levelled.groupBy("level").agg(F.count("*").alias("nodes"))


def largest_level(levelled: DataFrame) -> DataFrame:
    return level_sizes(levelled).agg(F.max("nodes").alias("largest"))


def reach(edges: DataFrame, start: DataFrame, direction: str = "upstream") -> DataFrame:
    """All tables before (or behind) each ``start.id``, with the least number of steps.

    Breadth-first: every (start, table) pair enters one wave only, so cycles end and
    no path is listed twice.
    """
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    pairs = materialise(edges.select(F.col(near).alias("id"), F.col(far).alias("next")).distinct(), "reach-edges")
    types = dict(pairs.dtypes)
    waves = Rounds(edges.sparkSession, "reach", f"start {types['id']}, id {types['id']}")
    wave = waves.add(start.select(F.col("id").alias("start"), "id").distinct())
    while not wave.isEmpty():
        wave = waves.add(
            pairs.join(wave, "id")
            .select("start", F.col("next").alias("id"))
            .distinct()
            .join(waves.all(), ["start", "id"], "left_anti")
        )
    return waves.all().where(F.col("round") > 0).withColumnRenamed("round", "steps")


# -- reachability by labels ------------------------------------------------------------------


@dataclass(frozen=True)
class Reachability:
    """Answers which of many pairs reach each other, without listing all that do.

    Groups of the condensed graph are strung on chains, each group after one before it.
    A group's labels say, for every chain it reaches, the lowest level reached there; all
    of the chain from that level on is reached as well. So a label stands for the rest of
    a chain, and a pair is decided by one lookup.
    """

    members: DataFrame  # id, group, chain, level, cyclic
    labels: DataFrame  # group, chain, lowest

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame) -> Reachability:
        """Labels of all nodes, layer by layer from the last one."""
        spark, kind = nodes.sparkSession, dict(nodes.dtypes)["id"]
        graph = condense(nodes, edges)
        layers = materialise(graph.layers, "reach-layers")
        placed = materialise(_chains(layers, graph.edges).join(layers, "id"), "reach-chains")  # id, chain, level
        ahead = materialise(
            graph.edges.join(placed.select(F.col("id").alias("source"), F.col("level").alias("from_level")), "source")
            .join(placed.toDF("target", "chain", "level"), "target"),
            "reach-ahead",
        )
        labels = Rounds(spark, "reach-labels", f"group {kind}, chain {kind}, lowest int")
        deepest = layers.agg(F.max("level")).first()[0]
        for level in range((deepest if deepest is not None else 0), -1, -1):
            out = ahead.where(F.col("from_level") == level)
            direct = out.select(F.col("source").alias("group"), "chain", F.col("level").alias("lowest"))
            if labels.number >= 0:
                further = out.select("source", F.col("target").alias("group")).join(labels.all().drop("round"), "group")
                direct = direct.unionByName(further.select(F.col("source").alias("group"), "chain", "lowest"))
            labels.add(direct.groupBy("group", "chain").agg(F.min("lowest").cast("int").alias("lowest")))
        several = graph.members.groupBy("group").agg((F.count("*") > 1).alias("cyclic"))
        loops = edges.where("source = target").select(F.col("source").alias("id"), F.lit(True).alias("loop")).distinct()
        members = (
            graph.members.join(placed.withColumnRenamed("id", "group"), "group").join(several, "group").join(loops, "id", "left")
            .select("id", "group", "chain", "level", (F.col("cyclic") | F.coalesce("loop", F.lit(False))).alias("cyclic"))
        )
        return Reachability(materialise(members, "reach-members"), labels.all().drop("round"))

    def depends(self, pairs: DataFrame) -> DataFrame:
        """Pairs (source, target) with ``reaches``: whether a way of an edge or more leads from one to the other.

        A node reaches itself on a cycle only; nodes that are not in the graph reach nothing.
        """
        one = self.members.select(F.col("id").alias("source"), F.col("group").alias("source_group"), "cyclic")
        other = self.members.select(
            F.col("id").alias("target"), F.col("group").alias("target_group"), F.col("chain").alias("target_chain"), "level"
        )
        known = pairs.select("source", "target").join(one, "source", "left").join(other, "target", "left")
        labels = self.labels.select(F.col("group").alias("source_group"), F.col("chain").alias("target_chain"), "lowest")
        same = (F.col("source_group") == F.col("target_group")) & ((F.col("source") != F.col("target")) | F.col("cyclic"))
        below = (F.col("source_group") != F.col("target_group")) & (F.col("lowest") <= F.col("level"))
        return known.join(labels, ["source_group", "target_chain"], "left").select(
            "source", "target", F.coalesce(same | below, F.lit(False)).alias("reaches")
        )


def _chains(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chain): every node follows at most one of the nodes before it, which it alone follows.

    Each node proposes to the least node behind it, and takes the least that proposes; the
    first node of a chain names it, found by pointer doubling.
    """
    proposed = edges.groupBy("source").agg(F.min("target").alias("target"))
    taken = proposed.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("at"))
    known = materialise(ids.select("id").join(taken, "id", "left").select("id", F.coalesce("at", "id").alias("at")), "reach-heads")
    while True:
        ahead = known.select(F.col("id").alias("at"), F.col("at").alias("next"))
        after = materialise(known.join(ahead, "at").select("id", F.col("next").alias("at"), (F.col("next") != F.col("at")).alias("moved")), "reach-heads")
        known = after.select("id", "at")
        if after.where("moved").isEmpty():
            return known.withColumnRenamed("at", "chain")
