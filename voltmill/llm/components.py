"""Consolidating pairwise matches into groups by large-star and small-star rewrites.

Edges are kept as (child, parent) with ``child > parent``. A large-star step points every neighbour that is larger
than a node to the least node of its neighbourhood; a small-star step does the same for the smaller neighbours and the
node itself. Steps alternate until neither changes an edge; every record is then linked to the minimum of its
component. Each step is two joins on the minimum per node, which is pre-aggregated before it is shuffled.

Scale. No neighbourhood is ever collected. The minima are a written table of one row per node, and so are the edges:
both sides of each join are plain reads, which adaptive skew joins can split, so a node that holds a third of all edges
is one row on one side and is spread over many tasks on the other. (An aggregate right before a join could not be
split.) All steps are written to the shared folder, so lineage stays short and a lost executor costs one step at most.
Superseded steps are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage


def _oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (child, parent); pairs with a null end and of a record with itself link nothing."""
    ends = pairs.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.filter(ends[2]).select("child", "parent").distinct()


def _least_parent(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least"))


def large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Point each child to the least parent of its parent; ``moved`` tells whether that is another node."""
    met = edges.join(least, edges.parent == least.node, "left")
    return met.select("child", F.coalesce("least", "parent").alias("parent"), F.col("least").isNotNull().alias("moved"))


def small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Point each node and all its parents to the least of these parents."""
    met = edges.join(least, edges.child == least.node)
    moved = met.filter("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"), F.lit(True).alias("moved"))
    kept = least.select(F.col("node").alias("child"), F.col("least").alias("parent"), F.lit(False).alias("moved"))
    return moved.unionByName(kept).groupBy("child", "parent").agg(F.max("moved").alias("moved"))


def component_ids(pairs: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """``(record, component)`` for every record that a pair links to another one.

    ``component`` is the least record of the connected component, whose own row is included. Pairs may repeat, come in
    either order, and have null or equal ends, which link nothing. No pairs give no rows. Other columns are ignored.
    Raises if ``most_rounds`` do not suffice (their number grows with the logarithm of the number of records).
    """
    stage = Stage(_oriented(pairs, a, b).withColumn("moved", F.lit(True)), "edges")
    for _ in range(most_rounds):
        changed = False
        for step in (large_star, small_star):
            edges = stage.df.select("child", "parent")
            least = Stage(_least_parent(edges), "least")
            after = Stage(step(edges, least.df), step.__name__, {"moved": F.max("moved")})
            stage.drop()
            least.drop()
            stage = after
            changed |= bool(stage.seen["moved"])
        if not changed:
            linked = stage.df.select("child", "parent")
            roots = linked.select(F.col("parent").alias("record"), F.col("parent").alias("component")).distinct()
            return linked.select(F.col("child").alias("record"), F.col("parent").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def star_edges(members: DataFrame, group: list[str], record: str, label: str, group_label: str) -> DataFrame:
    """Edges ``(a, b)`` that link the members of each group as all its compatible pairs would, one per member.

    Two members are compatible unless two different known labels are involved: theirs and the group's. With a known
    group label, all members with that label or none are one star. Without, a member without label is compatible with
    all and is the centre of one star; if there is none, each label is a star of its own. Null means unknown.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy(*group)
    fits = F.col(label).isNull() | (F.col(label) == F.col(group_label))
    open_centre = F.min(F.when(F.col(label).isNull(), F.col(record))).over(whole)
    ruled_centre = F.min(F.when(fits, F.col(record))).over(whole)
    same_centre = F.min(record).over(Window.partitionBy(*group, label))
    centre = F.when(F.col(group_label).isNotNull(), F.when(fits, ruled_centre)).otherwise(F.coalesce(open_centre, same_centre))
    return members.select(centre.alias("a"), F.col(record).alias("b")).filter("a is not null and a <> b")
