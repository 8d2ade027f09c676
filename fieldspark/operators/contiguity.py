"""Units without which their territory falls apart, for all territories at once.

A spanning forest is grown level by level. Without unit v the subtrees of its children and the rest of its territory hang together only by edges outside
the forest, so v is a cut vertex when these leave more than one piece. An edge outside the forest that leaves the subtree of v joins one child's subtree to the
rest; one between two children's subtrees joins these two. Whether it leaves shows in the numbers of a preorder, its least and greatest end in each
subtree. The pieces of all vertices are components of one graph.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .components import components


def forest(edges: DataFrame) -> DataFrame:
    """v, up (null at a root), depth of a breadth-first forest of edges (a, b); roots are the least of their component, parents the least possible."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "forest-edges")
    label = components(both)
    front = written(label.filter("a = class").select(F.col("a").alias("v"), F.lit(None).cast(both.schema["a"].dataType).alias("up"), F.lit(0).alias("depth")), "forest-level")
    out, depth = front, 0
    while True:
        depth += 1
        reach = front.join(both, F.col("v") == F.col("a")).groupBy(F.col("b").alias("w")).agg(F.min("v").alias("up"))
        new = written(reach.join(out.select(F.col("v").alias("w")), "w", "left_anti").select(F.col("w").alias("v"), "up", F.lit(depth).alias("depth")), "forest-level")
        if new.isEmpty():
            return out
        front, out = new, out.unionByName(new)


def numbered(tree: DataFrame) -> DataFrame:
    """v, up, depth, pre (place in a preorder of its tree, from 0) and size of its subtree."""
    tree = written(tree, "forest")
    top = tree.agg(F.max("depth")).first()[0] or 0
    size = written(tree.select("v", F.lit(1).cast("long").alias("size")), "forest-size")
    level = size.join(tree.filter(F.col("depth") == top).select("v"), "v")
    done = level
    for d in range(top - 1, -1, -1):  # sizes from the leaves up
        below = done.join(tree.filter(F.col("depth") == d + 1).select("v", "up"), "v").groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("under"))
        level = written(tree.filter(F.col("depth") == d).select("v").join(below, "v", "left").select("v", (1 + F.coalesce("under", F.lit(0))).alias("size")), "forest-size")
        done = done.unionByName(level)
    sized = written(tree.join(done, "v"), "forest-sized")
    beside = F.coalesce(F.sum("size").over(Window.partitionBy("up").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # children of one vertex
    offset = written(sized.filter("up is not null").withColumn("offset", 1 + beside), "forest-offset")
    out = level = written(sized.filter("up is null").select("v", F.lit(0).cast("long").alias("pre")), "forest-pre")
    for d in range(1, top + 1):  # places from the roots down
        at = level.withColumnsRenamed({"v": "up", "pre": "_pre"})
        level = written(offset.filter(F.col("depth") == d).join(at, "up").select("v", (F.col("_pre") + F.col("offset")).alias("pre")), "forest-pre")
        out = out.unionByName(level)
    return sized.join(out, "v")


def cut_vertices(edges: DataFrame) -> DataFrame:
    """v: the vertices of the graph of edges (a, b) without which their component falls into several."""
    tree = written(numbered(forest(edges)), "forest-numbered")
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    of = lambda c: tree.select(F.col("v").alias(c), F.col("up").alias(f"up_{c}"), F.col("pre").alias(f"pre_{c}"), F.col("depth").alias(f"depth_{c}"))
    ends = plain.join(of("a"), "a").join(of("b"), "b")
    other = written(ends.filter(~(F.coalesce(F.col("up_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("up_b") == F.col("a"), F.lit(False)))), "cut-other")
    # least and greatest end of the edges outside the forest that start in each subtree, from the leaves up
    own = other.select(F.col("a").alias("v"), F.col("pre_b").alias("p")).unionByName(other.select(F.col("b").alias("v"), F.col("pre_a").alias("p"))).groupBy("v").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    own = written(tree.select("v", "up", "depth").join(own, "v", "left"), "cut-own")
    top, all_ = tree.agg(F.max("depth")).first()[0] or 0, None
    level = own.filter(F.col("depth") == top).select("v", "up", "lo", "hi")
    for d in range(top, -1, -1):
        all_ = level if all_ is None else all_.unionByName(level)
        below = level.groupBy(F.col("up").alias("v")).agg(F.min("lo").alias("l2"), F.max("hi").alias("h2"))
        level = written(own.filter(F.col("depth") == d - 1).join(below, "v", "left").select("v", "up", F.least("lo", "l2").alias("lo"), F.greatest("hi", "h2").alias("hi")), "cut-reach")
    # a child's piece is the child, the rest's is the vertex itself where it is no root
    child = written(all_.filter("up is not null").join(tree.select(F.col("v").alias("up"), F.col("pre").alias("_pre"), F.col("size").alias("_size"), F.col("up").alias("_above")), "up"), "cut-children")
    out = F.coalesce((F.col("lo") < F.col("_pre")) | (F.col("hi") >= F.col("_pre") + F.col("_size")), F.lit(False))
    name = lambda v, piece: F.to_json(F.struct(F.col(v).alias("v"), F.col(piece).alias("p")))
    leaves = child.filter(out).select(name("up", "up").alias("a"), name("up", "v").alias("b"))
    # the children of the lowest common vertex that an edge outside the forest joins: climb from the deeper end, then from both
    climb = written(other.select(F.monotonically_increasing_id().alias("e"), "a", "b", F.col("depth_a").alias("da"), F.col("depth_b").alias("db")), "cut-climb")
    met = None
    above = lambda c: tree.select(F.col("v").alias(c), F.col("up").alias(f"u{c}"))
    while not climb.isEmpty():
        at = climb.join(above("a"), "a").join(above("b"), "b")
        here = at.filter("da = db and ua = ub").select(F.col("ua").alias("v"), "a", "b")
        met = written(here, "cut-met") if met is None else met.unionByName(written(here, "cut-met"))
        on = at.filter("not (da = db and ua = ub)").withColumn("low_a", F.col("da") >= F.col("db")).withColumn("low_b", F.col("db") >= F.col("da"))
        on = on.select("e", F.when(F.col("low_a"), F.col("ua")).otherwise(F.col("a")).alias("a"), F.when(F.col("low_b"), F.col("ub")).otherwise(F.col("b")).alias("b"), (F.col("da") - F.col("low_a").cast("int")).alias("da"), (F.col("db") - F.col("low_b").cast("int")).alias("db"))
        rest = written(on.filter("a <> b"), "cut-climb")  # an end that is above the other one meets it
        forget(climb)
        climb = rest
    joined = leaves if met is None else leaves.unionByName(met.select(name("v", "a").alias("a"), name("v", "b").alias("b")))
    nodes = child.select(F.col("up").alias("v"), name("up", "v").alias("n")).unionByName(child.filter("_above is not null").select(F.col("up").alias("v"), name("up", "up").alias("n"))).distinct()
    label = components(written(joined, "cut-joined"))
    pieces = nodes.join(label.select(F.col("a").alias("n"), "class"), "n", "left").groupBy("v").agg(F.countDistinct(F.coalesce("class", "n")).alias("k"))
    return pieces.filter("k > 1").select("v")
