"""Consolidating pairwise matches into groups (problem 6).

Minimum labels spread along the edges, pointer jumping shortens the way, and
every round is written to the shared folder until no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import BROADCAST_BYTES, BROADCAST_ROWS, drop_table, looked_up, materialize, measured


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of each node in the edges (a, b): label is the smallest node it is linked to, by code points.

    An edge with a NULL end makes the other end a node, linked to nothing by it; loops and repeated edges change
    nothing; an empty table gives an empty result.

    Each round, a node takes the smallest label among its own and its neighbours' (partial minima before the shuffle,
    so a node of a million edges costs one row per map task), then the label of its label.  Edges are cut down
    to those between different labels, so finished groups drop out.  Labels that move are broadcast where they are
    proven few; else a label's nodes and edges, of a giant group too, are dealt to many tasks.
    """
    edges = edges.select("a", "b")
    both = edges.filter("a <> b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).filter("node IS NOT NULL").distinct()
    # between labels, in both directions
    open_edges = materialize(both.union(both.select("b", "a")).distinct())
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while True:
        least = open_edges.groupBy("a").agg(F.min("b").alias("b")).filter("b < a")
        hops = materialize(least.select(F.col("a").alias("label"), F.col("b").alias("to")))
        n, size = measured(hops)
        if not n:
            drop_table(hops, open_edges)
            return labels
        few = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES  # jumping changes neither the rows nor, by much, their size
        # pointer jumping among the labels that move: each step halves the longest chain
        while True:
            further = looked_up(hops, hops.select(F.col("label").alias("x"), F.col("to").alias("y")), few, ("to", "x"))
            jumped = materialize(further.select("label", F.coalesce("y", "to").alias("to"), F.col("y").isNotNull().alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            drop_table(hops)
            hops = jumped.select("label", "to")
            if not moved:
                break
        ends = hops.select(F.col("label").alias("x"), F.col("to").alias("y"))
        new_labels = materialize(looked_up(labels, ends, few, ("label", "x")).select("node", F.coalesce("y", "label").alias("label")))
        moved_edges = looked_up(open_edges, ends, few, ("a", "x")).select(F.coalesce("y", "a").alias("a"), "b")
        moved_edges = looked_up(moved_edges, ends, few, ("b", "x")).select("a", F.coalesce("y", "b").alias("b"))
        new_edges = materialize(moved_edges.filter("a <> b").distinct())
        drop_table(labels, open_edges, hops)
        labels, open_edges = new_labels, new_edges


def question_links(questions: DataFrame) -> DataFrame:
    """Edges (a, b) between the chunks that one position of a question names.

    gold_chunks[i] and the members of relevant_groups[i] hang together; the smallest of them is linked to each (a
    star, not all pairs).  NULL arrays, lists and members are passed over; a chunk that is alone links to itself.
    """
    lists = F.arrays_zip(F.coalesce("gold_chunks", F.array().cast("array<string>")).alias("gold"), F.coalesce("relevant_groups", F.array().cast("array<array<string>>")).alias("group"))
    one = questions.select("gold_chunks", "relevant_groups").distinct().select(F.explode(lists).alias("p"))
    empty = F.array().cast("array<string>")
    members = F.array_compact(F.concat(F.array("p.gold"), F.coalesce("p.group", empty)))
    return one.select(members.alias("m")).filter(F.size("m") > 0).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).distinct()
