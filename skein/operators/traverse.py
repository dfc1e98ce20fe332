"""Traversals: k-hop context, investigation, blast radius of one or many roots, explanation."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.common import broadcast_if_small, cut
from skein.operators.lookup import callers, where
from skein.store import Graph, numbered, top

CONTEXT_NODES, CHAIN, DEPTH = 50, 50, 5
EXPLAIN_TYPES = ["reconciles", "creates", "calls", "tested_by"]


def context(g: Graph, root: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a root, up to three steps along edges in either direction.

    Nodes are resolvable ones, the first 50 by id. Edges are a bag: out- and in-edges of
    every node that was expanded, so an edge with both ends expanded is there twice.
    """
    depth = max(0, min(3, depth))
    both = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(g.edges.select("dst", "src"))
    seen = g.spark.createDataFrame([(root, 0)], "id string, level int")
    frontier = seen
    for level in range(1, depth + 1):
        step = both.join(broadcast_if_small(frontier.select(F.col("id").alias("a"))), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    nodes = top(g.entities.join(seen, "id"), CONTEXT_NODES, "id")
    expanded = broadcast_if_small(seen.filter(F.col("level") < depth).select("id"))
    out = g.edges.join(expanded.withColumnRenamed("id", "src"), "src")
    into = g.edges.join(expanded.withColumnRenamed("id", "dst"), "dst")
    return nodes, out.unionByName(into).orderBy("id")


def investigate(g: Graph, root: str, each: int = 20) -> dict[str, DataFrame]:
    """Out- and in-edges with their other ends, the first ``each`` of every type in the
    order of the edges; tests; callers; entities of the same file (by substring of the path)."""
    parts = {}
    for name, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        ends = g.entities.select(F.col("id").alias(there), F.col("name").alias("other_name"), F.col("kind").alias("other_kind"))
        found = g.links(here, root).join(ends, there)
        parts[name] = numbered(found, ["type"], "ord", "id").filter(F.col("n") <= each)
    parts["tests"] = parts["out"].filter(F.col("type") == "tested_by")
    parts["callers"] = callers(g, root)
    file = g.nodes(root).select("source_file").first()
    near = where(g, file[0], each + 1) if file else g.entities.filter("false")
    parts["siblings"] = top(near.filter(F.col("id") != root), each, "id")
    return parts


def impact(g: Graph, roots: DataFrame, depth: int = DEPTH, most: int = CHAIN) -> DataFrame:
    """(root, id, level, pos): the upstream chain of calls of many roots at once, in the order
    of a breadth-first walk (by the caller's place, then the edge's); the root has pos 1.

    The cap is tested after a node is added: when it is reached, each further level may still
    add the first new caller of its first node. So a chain has at most ``most + depth`` nodes,
    and of a callee no more than its first ``2 * most + depth`` callers can matter: the others
    are cut off, and a callee of a third of all functions is one row like any other. A level is
    one join of the frontiers with the callees' rows, of a capped root only its first node, and
    one shuffle by root in which what was seen before is told apart; each level is written once.
    """
    calls = g.edges.filter(F.col("type") == "calls").join(g.entities.select(F.col("id").alias("src")), "src", "left_semi")
    calls = calls.groupBy("dst", "src").agg(F.min(F.struct("ord", "id")).alias("o"))
    calls = numbered(calls, ["dst"], "o", "src").filter(F.col("n") <= 2 * most + depth)
    calls = calls.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("n", "src"))).alias("callers"))
    calls = cut(calls).repartition("dst").persist()  # each level joins it anew
    width = 2 * most + depth + 1
    columns = ["root", "id", "level", "pos"]
    first = roots.select(F.col("id").alias("root")).distinct()
    first = first.select("root", F.col("root").alias("id"), F.lit(0).alias("level"), F.lit(1).alias("pos"), F.lit(1).alias("n"), F.lit(1).alias("lead"))
    seen = [cut(first)]
    for level in range(1, depth + 1):
        asked = seen[-1].filter((F.col("n") < most) | (F.col("pos") == F.col("lead")))
        step = asked.withColumnRenamed("id", "dst").join(calls, "dst").select("root", "n", "lead", "pos", F.explode("callers").alias("c"))
        # places in the walk are one number: the callee's place, then the caller's among its callers
        step = step.select("root", F.col("c.src").alias("id"), "n", "lead", (F.col("pos") * width + F.col("c.n")).alias("k"))
        for old in seen:
            step = step.unionAll(old.select("root", "id", F.lit(0).alias("n"), F.lit(0).alias("lead"), F.lit(-1).alias("k")))
        new = step.repartition("root").groupBy("root", "id").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.max("lead").alias("lead")).filter("k >= 0")
        w = Window.partitionBy("root").orderBy("k")
        new = new.withColumn("i", F.row_number().over(w))
        kept = F.when(F.col("n") < most, F.col("i") <= most - F.col("n")).otherwise((F.col("i") == 1) & (F.floor(F.col("k") / width) == F.col("lead")))
        new = new.filter(kept).select("root", "id", F.lit(level).alias("level"), (F.col("n") + F.col("i")).alias("pos"), F.col("n").alias("was"))
        whole = Window.partitionBy("root")
        seen.append(cut(new.select(*columns, F.max("pos").over(whole).alias("n"), (F.col("was") + 1).alias("lead"))))
    calls.unpersist()
    out = seen[0].select(*columns)
    for part in seen[1:]:
        out = out.unionAll(part.select(*columns))
    return out


def impact_parts(g: Graph, chain: DataFrame, cap: int = 30) -> dict[str, DataFrame]:
    """What a chain touches, by root: controllers, files, owners, recent, tests, resources."""
    own = g.entities.select("id", "name", "kind", "source_file", "last_author", "last_modified")
    whole = chain.select("root", "id").join(own, "id")
    ends = g.edges.join(g.names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    reach = chain.select("root", F.col("id").alias("src")).join(ends.select("src", "dst", "dst_name", "type"), "src")

    def capped(df: DataFrame) -> DataFrame:
        found = df.select("root", F.col("dst").alias("id"), F.col("dst_name").alias("name")).distinct()
        return numbered(found, ["root"], "id").filter(F.col("n") <= cap).drop("n")

    return {
        "controllers": whole.filter(F.col("kind") == "controller").select("root", "id", "name"),
        "files": whole.filter(F.col("source_file") != "").select("root", "source_file").distinct(),
        "owners": whole.filter(F.col("last_author") != "").select("root", "last_author").distinct(),
        "recent": whole.filter(F.col("last_modified") != "").select("root", "id", "last_modified"),
        "tests": capped(reach.filter(F.col("type") == "tested_by")),
        "resources": capped(reach.filter(F.col("type").isin("reconciles", "creates"))),
    }


def explain(g: Graph, root: str, depth: int = 2, each: int = 20, calls: int = 10, most: int = 100) -> tuple[list[tuple], bool]:
    """([(pos, depth, parent, type, id)], capped): the tree of a depth-first walk along out-edges.

    The walk depends on its order, so it runs on the driver, over a bounded neighbourhood:
    a node visits at most ``each`` targets of a type and skips at most ``most`` visited ones.
    """
    depth = 2 if depth <= 0 else min(3, depth)
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(EXPLAIN_TYPES) for x in (t, i)])
    edges = g.edges.filter(F.col("type").isin(EXPLAIN_TYPES)).join(g.entities.select(F.col("id").alias("dst")), "dst", "left_semi")
    edges = edges.select("src", "type", "dst").distinct()
    adjacent: dict[str, list[tuple]] = {}
    frontier, met = [root], {root}
    for _ in range(depth):
        if not frontier:
            break
        near = numbered(edges.filter(F.col("src").isin(frontier)) if len(frontier) <= 500 else edges.join(F.broadcast(g.spark.createDataFrame([(x,) for x in frontier], "src string")), "src"), ["src", "type"], "dst")
        rows = near.filter(F.col("n") <= each + most).select("src", rank[F.col("type")].alias("t"), "dst").collect()
        for src, t, dst in sorted(rows):
            adjacent.setdefault(src, []).append((t, dst))
        frontier = sorted({dst for _, _, dst in rows} - met)
        met.update(frontier)
    out, visited, capped = [(0, 0, "", "", root)], {root}, False

    def walk(node: str, level: int) -> None:
        nonlocal capped
        if level >= depth:
            return
        taken: dict[int, int] = {}
        for t, dst in adjacent.get(node, ()):
            if dst in visited or taken.get(t, 0) >= (calls if EXPLAIN_TYPES[t] == "calls" else each):
                continue
            if len(out) >= most:
                capped = True
                return
            taken[t] = taken.get(t, 0) + 1
            visited.add(dst)
            out.append((len(out), level + 1, node, EXPLAIN_TYPES[t], dst))
            walk(dst, level + 1)

    walk(root, 0)
    return out, capped


