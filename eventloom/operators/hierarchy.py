"""Trees held as parent ids: paths, cycles and subtree search, level by level with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import discard, staged


def paths(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(id, depth, path): every node under a root. One join for each level of the tree, which ends at the deepest."""
    level = nodes.where("parent_id is null").select("id", F.lit(0).cast("bigint").alias("depth"), F.col("name").alias("path"))
    out = level
    for _ in range(most):
        kids = nodes.alias("n").join(level.alias("p"), F.col("n.parent_id") == F.col("p.id"))
        level = kids.select("n.id", (F.col("p.depth") + 1).alias("depth"), F.concat("p.path", F.lit(" > "), "n.name").alias("path"))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError("the tree is deeper than allowed")


def ancestors(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(id, ancestor, steps): all pairs, each with its fewest steps; a node that is its own ancestor is on a cycle. Walks until
    no pair is new; each level is staged, so that deep trees keep short plans."""
    step = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor")).distinct()
    ahead = step.select(F.col("id").alias("at"), F.col("ancestor").alias("up"))
    out = walk = staged(step.withColumn("steps", F.lit(1).cast("bigint")), "ancestors")
    for _ in range(most):
        further = walk.join(ahead, F.col("ancestor") == F.col("at")).select("id", F.col("up").alias("ancestor"), (F.col("steps") + 1).alias("steps")).distinct()
        walk = staged(further.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "ancestors")
        if walk.isEmpty():
            return out
        out = out.union(walk)
    raise ValueError("the tree is deeper than allowed")


def _cycles(links: DataFrame) -> DataFrame:
    """(id, latest): the nodes on cycles, with the greatest `ord` of the nodes of their cycle.

    links is (id, up, ord), one parent a node. By pointer doubling: each round a node's pointer leaps twice as far, and a node whose
    pointer has left the tree is dropped, so a tree of depth d takes log2(d) rounds with one row a node. When nothing more is dropped and
    the leap is at least as long as what is left is large, every pointer that is left ends on a cycle, and all nodes of cycles are hit.
    """
    alive = staged(links.where("up is not null"), "leaps")
    before, leap = None, 1
    while True:
        left = alive.count()
        if left == 0 or (left == before and leap >= left):
            break
        ahead = alive.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("ord").alias("ord_ahead"))
        further = staged(alive.join(ahead, "up").select("id", F.col("further").alias("up"), F.greatest("ord", "ord_ahead").alias("ord")), "leaps")
        discard(alive)
        alive, before, leap = further, left, 2 * leap
    return alive.join(alive.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", F.col("ord").alias("latest"))


def on_cycle(nodes: DataFrame) -> DataFrame:
    """(id): nodes that are their own ancestors, in (id, parent_id) with one parent a node. Nulls, repeated rows and unknown parents are
    no links."""
    links = nodes.where("id is not null").select("id", F.col("parent_id").alias("up")).distinct()
    return _cycles(links.withColumn("ord", F.lit(0))).select("id")


def moved(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, parent_id, sort_order, outcome) of a tree (id, parent_id, sort_order) after a batch of moves (id, parent_id, sort_order, ord).

    All moves are made at once: a null parent makes a root, moves of one id twice count by the greatest ord, of unknown ids or to unknown
    parents not at all (an unknown parent's is `no_parent`). While the tree has cycles, each cycle's latest move, by its ord, is taken
    back together with its position (`cycle`); the rest is `moved`, and what no move names is `kept`. ord must tell moves apart. Cycles
    that the tree had before are an error, as no move can be blamed.
    """
    known = tree.select(F.col("id").alias("new_parent")).distinct().withColumn("known", F.lit(True))
    asked = moves.groupBy("id").agg(F.max_by(F.struct(F.col("parent_id").alias("new_parent"), F.col("sort_order").alias("new_order")), "ord").alias("m"), F.max("ord").alias("ord"))
    asked = asked.select("id", "m.*", "ord").join(known, "new_parent", "left")
    state = tree.join(asked, "id", "left").withColumn(
        "outcome", F.when(F.col("ord").isNull(), "kept").when(F.col("new_parent").isNotNull() & F.col("known").isNull(), "no_parent").otherwise("moved")
    )
    state = staged(state, "moves")
    made = F.col("outcome") == "moved"
    while True:
        links = state.select("id", F.when(made, F.col("new_parent")).otherwise(F.col("parent_id")).alias("up"), F.when(made, F.col("ord")).alias("ord"))
        found = staged(_cycles(links), "cycles")
        if found.isEmpty():
            break
        if not found.where("latest is null").isEmpty():
            raise ValueError("the tree has a cycle without any move")
        back = found.select(F.col("latest").alias("ord")).distinct().withColumn("closes", F.lit(True))
        after = staged(state.join(back, "ord", "left").withColumn("outcome", F.when(F.col("closes") & made, "cycle").otherwise(F.col("outcome"))).select(state.columns), "moves")
        discard(state, found)
        state = after
    pick = lambda new, old: F.when(made, F.col(new)).otherwise(F.col(old)).alias(old)
    return state.select("id", pick("new_parent", "parent_id"), pick("new_order", "sort_order"), "outcome")


def search(nodes: DataFrame, text: str) -> DataFrame:
    """(id, matched): the nodes whose name has the text, and all their ancestors."""
    found = nodes.where(F.lower("name").contains(text.lower())).select("id")
    above = ancestors(nodes).join(found, "id").select(F.col("ancestor").alias("id")).distinct()
    return found.withColumn("m", F.lit(True)).union(above.withColumn("m", F.lit(False))).groupBy("id").agg(F.max("m").alias("matched"))
