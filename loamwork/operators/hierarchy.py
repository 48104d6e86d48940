"""Parent-child links to full hierarchies.

Level-wise frontier joins: the pairs reached at one level are joined with the
links to give the next levels, and what was reached before is taken away. A
join goes several levels at once: the ways of up to eight links are made first. The
loop ends at the first empty frontier, so depth needs no bound and cycles end
by themselves. A node met again on its own way down lies on a cycle; nodes
that no root reaches hang on a cycle, and are entered at the least node of the
topmost cycle.

Defined results: links with a null end are no links; repeated links count
once; a node linked to itself is its own descendant and on a cycle; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.storage import Parts, Run, drop, settle, shuffle_partitions


def _links(links: DataFrame, parent: Column, child: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and distinct links (src, dst) over ids that are short to shuffle."""
    named = settle(links.select(parent.alias("p"), child.alias("c")).where("p is not null and c is not null").distinct(), "links")
    names = named.select(F.col("p").alias("name")).union(named.select("c")).distinct()
    nodes = settle(names.select(F.monotonically_increasing_id().alias("id"), "name"), "nodes")
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("p"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("c"))
    edges = settle(named.join(a, "p").join(b, "c").select("src", "dst"), "edges")
    drop(named)
    return nodes, edges


def _hops(edges: DataFrame, levels: int, sep: str | None = None) -> DataFrame:
    """(src, dst, level) of all ways of up to ``levels`` edges (src, dst), the shortest; with ``sep`` also the least text of those.

    Each join doubles the levels. These pairs are part of the closure, so they are never more than the result.
    """
    if sep is None:
        least = lambda df: df.groupBy("src", "dst").agg(F.min("level").alias("level"))
        texts: list = []
    else:
        least = lambda df: df.groupBy("src", "dst").agg(F.min(F.struct("level", "text")).alias("x")).select("src", "dst", "x.*")
        texts = [F.concat("first", F.lit(sep), "text").alias("text")]
    hops, reach = edges.select("src", "dst", F.lit(1).alias("level"), *(["text"] if texts else [])), 1
    while reach < levels:
        far = hops.where(F.col("level") == reach).select("src", F.col("dst").alias("mid"), *([F.col("text").alias("first")] if texts else []))
        on = hops.withColumnRenamed("src", "mid")
        further = far.join(on, "mid").select("src", "dst", (F.col("level") + reach).alias("level"), *texts)
        former, hops, reach = hops, settle(least(hops.union(further)), "hops"), reach * 2
        drop(former)
    return hops


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two runs without a pair in common, bucket by bucket."""
    return a.select("anc", "node", "level").join(b.select("anc", "node", F.col("level").alias("other")), ["anc", "node"], "full_outer").select("anc", "node", F.coalesce("level", "other").alias("level"))


def _pairs(edges: DataFrame, levels: int = 8) -> DataFrame:
    """All (anc, node) over one or more links; each frontier join goes ``levels`` levels, a power of two, down.

    What was reached lies bucketed by pair. What a round finds is grouped by pair, and so meets it without moving it;
    frontiers and links are shuffled by node, where adaptive execution splits a node that very many ways pass.
    """
    buckets = shuffle_partitions(edges.sparkSession)
    hops = _hops(edges, levels)
    frontier = Run(hops.select(F.col("src").alias("anc"), F.col("dst").alias("node"), "level"), ["anc", "node"], buckets, "pairs")
    step = hops.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("level").alias("down"))
    tiers = [(0, frontier)]
    while True:
        last = frontier.df().where(F.col("level") == levels).select("anc", "node")
        found = last.join(step, "node").groupBy("anc", F.col("next").alias("node")).agg(F.min("down").alias("level"))
        for _, r in tiers:
            found = found.join(r.df().select("anc", "node"), ["anc", "node"], "left_anti")
        new = Run(found, ["anc", "node"], buckets, "pairs", placed=True)
        if new.df().isEmpty():
            new.drop()
            break
        # two runs of a tier become one of the next, but for the frontier itself
        while len(tiers) > 2 and tiers[-3][0] == tiers[-2][0]:
            (tier, a), (_, b) = tiers[-3], tiers[-2]
            tiers[-3:-1] = [(tier + 1, Run(_both(a.df(), b.df()), ["anc", "node"], buckets, "pairs", placed=True))]
            a.drop(), b.drop()
        frontier = new
        tiers.append((0, new))
    out = tiers[0][1].df().select("anc", "node")
    for _, r in tiers[1:]:
        out = out.union(r.df().select("anc", "node"))
    return out


def descendants(links: DataFrame, parent: Column, child: Column) -> DataFrame:
    """(ancestor, descendant) for all pairs joined by one or more links."""
    nodes, edges = _links(links, parent, child)
    pairs = _pairs(edges)
    a = nodes.select(F.col("id").alias("anc"), F.col("name").alias("ancestor"))
    d = nodes.select(F.col("id").alias("node"), F.col("name").alias("descendant"))
    return pairs.join(a, "anc").join(d, "node").select("ancestor", "descendant")


def _walk(start: DataFrame, edges: DataFrame, names: DataFrame, separator: str, levels: int = 8) -> DataFrame:
    """Shortest way from the start rows (node, root, depth, path) to each node; the least path of those."""
    named = edges.join(names, edges.dst == names.id).select("src", "dst", F.col("name").alias("text"))
    step = _hops(named, levels, separator).select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("level").alias("down"), "text")
    frontier = settle(start, "reached")
    reached = Parts(frontier, "reached")
    depth = 0
    while True:
        last = frontier.where(F.col("depth") == depth)
        grown = last.join(step, "node").select(F.col("next").alias("node"), "root", (F.col("depth") + F.col("down")).alias("depth"), F.concat("path", F.lit(separator), "text").alias("path"))
        best = grown.groupBy("node").agg(F.min(F.struct("depth", "path", "root")).alias("best")).join(reached.df().select("node"), "node", "left_anti")
        frontier = settle(best.select("node", "best.root", "best.depth", "best.path"), "reached")
        if frontier.isEmpty():
            return reached.df()
        reached.add(frontier)
        depth += levels


def hierarchy(links: DataFrame, parent: Column, child: Column, separator: str = " -> ") -> DataFrame:
    """(node, root, depth, path, descendants, on_cycle) for every node.

    ``path`` is a shortest way from a root, the least by text among equals;
    ``descendants`` counts the nodes below. Below a cycle that no root
    reaches, the way starts at the least node of the cycle.
    """
    nodes, edges = _links(links, parent, child)
    pairs = settle(_pairs(edges), "closure")
    roots = nodes.join(edges.where("src <> dst"), nodes.id == edges.dst, "left_anti")
    start = roots.select(F.col("id").alias("node"), F.col("name").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("path"))
    reached = _walk(start, edges, nodes, separator)
    unreached = nodes.join(reached, nodes.id == reached.node, "left_anti")
    if not unreached.isEmpty():
        # only nodes on cycles, which are their own descendants, can reach each other
        cyclic = pairs.where("anc = node").select("anc")
        among = settle(pairs.join(cyclic, "anc", "left_semi").join(cyclic.withColumnRenamed("anc", "node"), "node", "left_semi").select("anc", "node"), "cyclic")
        mutual = among.alias("x").join(among.alias("y"), F.expr("x.anc = y.node and x.node = y.anc")).select("x.anc", "x.node")
        above = pairs.join(mutual, ["anc", "node"], "left_anti").select(F.col("node").alias("id")).distinct()
        top = mutual.select(F.col("anc").alias("id"), F.col("node").alias("peer")).join(unreached, "id").join(above, "id", "left_anti")
        entry = top.join(nodes.select(F.col("id").alias("peer"), F.col("name").alias("peer_name")), "peer").groupBy("id", "name").agg(F.min("peer_name").alias("least")).where("name = least")
        more = _walk(entry.select(F.col("id").alias("node"), F.col("name").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("path")), edges, nodes, separator)
        reached = reached.union(more.join(reached.select("node"), "node", "left_anti").select("node", "root", "depth", "path"))
    below = pairs.groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("n"), F.max(F.expr("anc = node")).alias("cyclic"))
    return (
        nodes.join(reached, nodes.id == reached.node)
        .join(below, "id", "left")
        .select(F.col("name").alias("node"), "root", "depth", "path", F.coalesce("n", F.lit(0)).cast("long").alias("descendants"), F.coalesce("cyclic", F.lit(False)).cast("int").alias("on_cycle"))
    )
