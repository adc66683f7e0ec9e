"""Property-graph operators over an edge table (rel_id, s, r, t, w, c): neighbours, paths, closure, rollups.

s and t are node ids, r the relation, w the weight, c the confidence. Paths never visit a node twice; every
loop is unrolled to a bounded number of hops and ties are broken by ids, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallix.operators.components import components
from recallix.session import checkpoint


def latest(log: DataFrame, key: str, order: list[str], columns: dict[str, Column], gone: Column) -> DataFrame:
    """The current state of a change log: the last row of each key, unless it deletes. Pre-aggregated before the shuffle."""
    row = F.struct(*[F.col(c) for c in order], F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__v"), F.coalesce(gone, F.lit(False)).alias("__gone"))
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__row"))
    return last.where(~F.col("__row.__gone")).select(key, "__row.__v.*")


def neighbours(edges: DataFrame, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """(seed, node, r, direction, w, c): up to `limit` neighbours of each seed.

    Outgoing edges come first, incoming ones fill what is left; each by confidence, then weight, falling.
    """
    one = lambda own, other, name: edges.join(seeds.select(F.col("seed")), edges[own] == F.col("seed")).select("seed", F.col(other).alias("node"), "r", F.lit(name).alias("direction"), "w", "c", "rel_id")
    both = one("s", "t", "outgoing").unionByName(one("t", "s", "incoming"))
    w = Window.partitionBy("seed").orderBy(F.desc("direction"), F.desc("c"), F.desc("w"), "rel_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("seed", "node", "r", "direction", "w", "c", "rank")


def simple_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 3, per_pair: int = 5, by: str = "hops", importance: float = 0.6, certainty: float = 0.4, beam: int | None = None) -> DataFrame:
    """(start, goal, hops, path, relations, cost): the best `per_pair` simple paths from each start to each node.

    by `hops`: the fewest hops first, then in order of the path. by `cost`: an edge costs
    1 / (importance * clip(w, .1, 1) + certainty * clip(c, .1, 1)), the cheapest first. With `beam` only the best
    that many open paths of a start go on at each hop.
    """
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.1)), F.lit(1.0))
    steps = edges.where("s <> t").select(F.col("s").alias("at"), F.col("t").alias("to"), "r", (1.0 / (importance * clip("w") + certainty * clip("c"))).alias("step"))
    front = starts.select(F.col("seed").alias("start"), F.col("seed").alias("goal"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("relations"), F.lit(0.0).alias("cost"))
    found = None
    for _ in range(max_hops):
        front = front.join(steps, front["goal"] == steps["at"]).where(~F.array_contains("path", F.col("to")))
        front = front.select("start", F.col("to").alias("goal"), F.concat("path", F.array("to")).alias("path"), F.concat("relations", F.array("r")).alias("relations"), (F.col("cost") + F.col("step")).alias("cost"))
        if beam:
            w = Window.partitionBy("start").orderBy("cost", "path", "relations")
            front = front.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= beam).drop("__n")
        found = front if found is None else found.unionByName(front)
    found = found.withColumn("hops", F.size("relations"))
    order = ["hops", "path", "relations"] if by == "hops" else ["cost", "hops", "path", "relations"]
    w = Window.partitionBy("start", "goal").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_pair).select("start", "goal", "hops", "path", "relations", "cost", "rank")


def meeting_paths(edges: DataFrame, pairs: DataFrame, half: int = 2) -> DataFrame:
    """(start, goal, hops, path): all simple paths of up to 2 * half hops between given pairs, met in the middle.

    `half` hops forward from each start and backward from each goal are joined where they meet; a path of n
    hops is taken at one middle only, its node after ceil(n / 2) hops.
    """
    forward = edges.where("s <> t").select(F.col("s").alias("at"), F.col("t").alias("to"))
    back = edges.where("s <> t").select(F.col("t").alias("at"), F.col("s").alias("to"))

    def walks(ends: DataFrame, steps: DataFrame, name: str) -> DataFrame:
        level = ends.select(F.col(name), F.col(name).alias("end"), F.array(name).alias("walk"))
        out = level
        for _ in range(half):
            level = level.join(steps, level["end"] == steps["at"]).where(~F.array_contains("walk", F.col("to"))).select(name, F.col("to").alias("end"), F.concat("walk", F.array("to")).alias("walk"))
            out = out.unionByName(level)
        return out.distinct()

    a = walks(pairs.select("start").distinct(), forward, "start").join(pairs, "start")
    b = walks(pairs.select("goal").distinct(), back, "goal").select("goal", F.col("end").alias("end2"), F.col("walk").alias("back_walk"))
    met = a.join(b, (a["goal"] == b["goal"]) & (a["end"] == b["end2"])).select("start", a["goal"], "walk", "back_walk")
    met = met.where((F.size("walk") - F.size("back_walk")).isin(0, 1)).withColumn("path", F.concat("walk", F.expr("slice(reverse(back_walk), 2, size(back_walk))")))
    return met.where("size(path) > 1 and size(array_distinct(path)) = size(path)").select("start", "goal", (F.size("path") - 1).alias("hops"), "path").distinct()


def hop_distances(edges: DataFrame, starts: DataFrame, max_hops: int = 3) -> DataFrame:
    """(start, node, hops): breadth-first distances, directed, up to max_hops."""
    seen = starts.select(F.col("seed").alias("start"), F.col("seed").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, max_hops + 1):
        front = front.join(edges, front["node"] == edges["s"]).select("start", F.col("t").alias("node"), F.lit(h).alias("hops")).distinct()
        seen = seen.unionByName(front).groupBy("start", "node").agg(F.min("hops").alias("hops"))
        front = seen.where(F.col("hops") == h)
    return seen


def contract(edges: DataFrame, least_weight: float = 0.2, least_confidence: float = 0.3) -> DataFrame:
    """(s, t, w, c, relations, n): edges above both thresholds, parallel ones made one."""
    kept = edges.where((F.col("w") >= least_weight) & (F.col("c") >= least_confidence))
    return kept.groupBy("s", "t").agg(F.round(F.avg("w"), 6).alias("w"), F.round(F.avg("c"), 6).alias("c"), F.array_join(F.array_sort(F.collect_set("r")), " & ").alias("relations"), F.count(F.lit(1)).alias("n"))


def closure(edges: DataFrame, relation: str, max_hops: int = 4, weight_decay: float = 0.8, confidence_decay: float = 0.9) -> DataFrame:
    """(s, t, w, c, hops): pairs of a transitive relation; each added hop decays the lesser weight and confidence.

    Of several derivations of a pair the one of highest confidence counts, then of highest weight, then of fewest
    hops. Semi-naive: a round joins only the pairs that are new or better; lineage is cut each round.
    """
    base = edges.where((F.col("r") == relation) & (F.col("s") != F.col("t")))
    best = lambda df: df.groupBy("s", "t").agg(F.max(F.struct("c", "w", (-F.col("hops")).alias("h"))).alias("b")).select("s", "t", F.col("b.w").alias("w"), F.col("b.c").alias("c"), (-F.col("b.h")).alias("hops"))
    one = checkpoint(best(base.select("s", "t", "w", "c", F.lit(1).alias("hops"))))
    known, front = one, one
    right = one.select(F.col("s").alias("via"), F.col("t").alias("t2"), F.col("w").alias("w2"), F.col("c").alias("c2"))
    for h in range(2, max_hops + 1):
        front = front.join(right, front["t"] == right["via"]).where("s <> t2").select("s", F.col("t2").alias("t"), (F.least("w", "w2") * weight_decay).alias("w"), (F.least("c", "c2") * confidence_decay).alias("c"), F.lit(h).alias("hops"))
        front = checkpoint(best(front))
        if front.isEmpty():
            break
        known = best(known.unionByName(front))
    return known


def partition_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, nodes, edges, density) of a partition (node, component); density is edges / (n (n - 1))."""
    nodes = labels.groupBy(F.col("component").alias("part")).agg(F.count(F.lit(1)).alias("nodes"))
    inside = edges.select("s", "t").where("s <> t").distinct().join(labels.select(F.col("node").alias("s"), F.col("component").alias("part")), "s").join(labels.select(F.col("node").alias("t"), F.col("component").alias("part2")), "t").where("part = part2")
    counted = inside.groupBy("part").agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("nodes")
    return nodes.join(counted, "part", "left").select("part", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(n > 1, F.round(F.coalesce("edges", F.lit(0)) / (n * (n - 1)), 6)).otherwise(0.0).alias("density"))


def communities(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(node, community) by synchronous label propagation: the commonest label around, the smallest on ties."""
    e = edges.where("s <> t").select("s", "t").distinct()
    around = checkpoint(e.unionByName(e.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
    labels = around.select(F.col("s").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = around.join(labels, around["t"] == labels["node"]).groupBy("s", "community").count()
        labels = checkpoint(votes.groupBy("s").agg(F.max(F.struct("count", (-F.col("community")).alias("l"))).alias("m")).select(F.col("s").alias("node"), (-F.col("m.l")).alias("community")))
    return labels


def abstraction(edges: DataFrame, labels: DataFrame, kinds: DataFrame, smallest: int = 3) -> DataFrame:
    """(community, size, representative, kind): supernodes: their size, node of highest degree and commonest kind."""
    degree = edges.where("s <> t").select(F.explode(F.array("s", "t")).alias("node")).groupBy("node").count()
    rows = labels.join(degree, "node").join(kinds, "node", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    top = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("count", (-F.col("node")).alias("n"))).alias("m"))
    modal = rows.groupBy("community", "kind").agg(F.count(F.lit(1)).alias("k")).groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), "kind")).alias("m2"))
    return top.join(modal, "community").where(F.col("size") >= smallest).select("community", "size", (-F.col("m.n")).alias("representative"), F.col("m2.kind").alias("kind"))


def between_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cs, ct, w, n): mean weight and number of the edges between two communities."""
    a, b = labels.select(F.col("node").alias("s"), F.col("community").alias("cs")), labels.select(F.col("node").alias("t"), F.col("community").alias("ct"))
    return edges.join(a, "s").join(b, "t").where("cs <> ct").groupBy("cs", "ct").agg(F.round(F.avg("w"), 6).alias("w"), F.count(F.lit(1)).alias("n"))


def two_hop_patterns(edges: DataFrame, least: int = 10) -> DataFrame:
    """(r1, r2, n): pairs of relations on two-hop walks that don't return, at least `least` times.

    Counted by degree, not by listing walks: edges are counted by middle node and relation before they are joined;
    walks back to where they began are counted apart and taken off.
    """
    into = edges.groupBy(F.col("t").alias("mid"), F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("a"))
    out = edges.groupBy(F.col("s").alias("mid"), F.col("r").alias("r2")).agg(F.count(F.lit(1)).alias("b"))
    walks = into.join(out, "mid").groupBy("r1", "r2").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    first = edges.groupBy("s", "t", F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("a"))
    second = edges.groupBy(F.col("s").alias("t"), F.col("t").alias("s"), F.col("r").alias("r2")).agg(F.count(F.lit(1)).alias("b"))
    back = first.join(second, ["s", "t"]).groupBy("r1", "r2").agg(F.sum(F.col("a") * F.col("b")).alias("m"))
    return walks.join(back, ["r1", "r2"], "left").select("r1", "r2", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where(F.col("n") >= least)


def three_hop_patterns(edges: DataFrame, top: int = 20) -> DataFrame:
    """(pattern, n): the `top` commonest relation sequences of three-hop walks, counted by degree."""
    into = edges.groupBy("t", F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("a")).withColumnRenamed("t", "u")
    out = edges.groupBy("s", F.col("r").alias("r3")).agg(F.count(F.lit(1)).alias("b")).withColumnRenamed("s", "v")
    middle = edges.select(F.col("s").alias("u"), F.col("t").alias("v"), F.col("r").alias("r2"))
    walks = middle.join(into, "u").groupBy("v", "r1", "r2").agg(F.sum("a").alias("a")).join(out, "v").groupBy("r1", "r2", "r3").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    return walks.select(F.concat_ws("|", "r1", "r2", "r3").alias("pattern"), "n").orderBy(F.desc("n"), "pattern").limit(top)


def subgraph(edges: DataFrame, seeds: DataFrame, each: int = 5) -> DataFrame:
    """(s, t, r): the distinct edges between the seeds and up to `each` neighbours of every seed."""
    near = neighbours(edges, seeds, each)
    out = F.col("direction") == "outgoing"
    return near.select(F.when(out, F.col("seed")).otherwise(F.col("node")).alias("s"), F.when(out, F.col("node")).otherwise(F.col("seed")).alias("t"), "r").distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph; nodes of loops count."""
    return components(edges, "s", "t")


def conflicts(edges: DataFrame, hierarchical: list[str], attributes: str) -> DataFrame:
    """(kind, a, b, r): taxonomy edges that also run backwards, and attribute relations with several targets.

    An attribute conflict is one row a source and relation: a is the source, b the number of its targets.
    """
    tax = edges.where(F.col("r").isin(hierarchical)).select("s", "t", "r").distinct()
    back = tax.select(F.col("t").alias("s"), F.col("s").alias("t"), "r")
    cycles = tax.join(back, ["s", "t", "r"], "left_semi").where("s < t").select(F.lit("cycle").alias("kind"), F.col("s").alias("a"), F.col("t").alias("b"), "r")
    many = edges.where(F.col("r").rlike(attributes)).groupBy("s", "r").agg(F.count_distinct("t").alias("n")).where("n > 1").select(F.lit("attribute").alias("kind"), F.col("s").alias("a"), F.col("n").alias("b"), "r")
    return cycles.unionByName(many)


def merge_relations(edges: DataFrame) -> DataFrame:
    """(s, r, t, w, c, provenances, n): equal relations made one: the highest weight and confidence, all sources."""
    return edges.groupBy("s", "r", "t").agg(F.max("w").alias("w"), F.max("c").alias("c"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("provenances"), F.count(F.lit(1)).alias("n"))


def derived_edges(edges: DataFrame, symmetric: list[str], inverse: dict[str, str]) -> DataFrame:
    """(s, r, t, origin): edges with those that symmetric relations and inverses imply; stated ones win."""
    base = edges.select("s", "r", "t", F.lit("stated").alias("origin"))
    turned = edges.where(F.col("r").isin(symmetric)).select(F.col("t").alias("s"), "r", F.col("s").alias("t"), F.lit("symmetric").alias("origin"))
    names = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    other = edges.where(F.col("r").isin(list(inverse))).select(F.col("t").alias("s"), names[F.col("r")].alias("r"), F.col("s").alias("t"), F.lit("inverse").alias("origin"))
    rank = F.when(F.col("origin") == "stated", 0).when(F.col("origin") == "inverse", 1).otherwise(2)
    return base.unionByName(turned).unionByName(other).groupBy("s", "r", "t").agg(F.min_by("origin", rank).alias("origin"))


def explain(paths: DataFrame) -> DataFrame:
    """Adds `text`: the path in words, `1 -knows-> 2`."""
    step = F.transform(F.sequence(F.lit(1), F.size("relations")), lambda i: F.concat(F.lit(" -"), F.element_at("relations", i), F.lit("-> "), F.element_at("path", i + 1).cast("string")))
    return paths.withColumn("text", F.concat(F.element_at("path", 1).cast("string"), F.array_join(step, "")))


def resolve_conflicts(edges: DataFrame, attributes: str, by: str = "confidence") -> DataFrame:
    """Edges with one target left for each source and attribute relation: the surest, or the newest, of them.

    by is `confidence` (then the weight) or `recency` (column ts); the least rel_id decides among equals.
    """
    order = [F.desc("c"), F.desc("w")] if by == "confidence" else [F.desc("ts")]
    one = F.col("r").rlike(attributes)
    best = edges.where(one).withColumn("__n", F.row_number().over(Window.partitionBy("s", "r").orderBy(*order, "rel_id"))).where("__n = 1").drop("__n")
    return edges.where(~one).unionByName(best)


def search(edges: DataFrame, names: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, text, score, rank): facts about the entities (id, entity) that asked (qid, name) names.

    Neighbours of entities of that name score their weight; entities whose name has the asked one as a word score 0.4.
    """
    hit = asked.join(names, F.lower(asked["name"]) == F.lower(names["entity"])).select("qid", F.col("id").alias("seed"), "entity")
    near = neighbours(edges, hit.select("seed").distinct(), limit)
    other = names.select(F.col("id").alias("node"), F.col("entity").alias("other"))
    one = hit.join(near, "seed").join(other, "node").select("qid", F.when(F.col("direction") == "outgoing", F.concat_ws(" ", "entity", "r", "other")).otherwise(F.concat_ws(" ", "other", "r", "entity")).alias("text"), F.col("w").alias("score"))
    words = names.select("entity", F.explode(F.array_distinct(F.split(F.lower("entity"), r"\s+"))).alias("word"))
    two = asked.join(words, F.lower(asked["name"]) == words["word"]).select("qid", F.col("entity").alias("text"), F.lit(0.4).alias("score"))
    best = one.unionByName(two).groupBy("qid", "text").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "text"))).where(F.col("rank") <= limit)


def supernode_paths(edges: DataFrame, labels: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """(start, goal, hops, path): the best path over communities (node, community) from each seed's to every other.

    An edge between two nodes is one between their communities, so the graph that is searched is far smaller.
    """
    small = between_communities(edges, labels).select(F.col("cs").alias("s"), F.col("ct").alias("t"), F.lit("linked").alias("r"), "w", F.lit(1.0).alias("c"))
    starts = labels.join(seeds, labels["node"] == seeds["seed"], "left_semi").select(F.col("community").alias("seed")).distinct()
    best = simple_paths(checkpoint(small), starts, max_hops, per_pair=1)
    return best.select("start", "goal", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def consistency(edges: DataFrame, single: list[str]) -> DataFrame:
    """(r, groups, contradictory, score): of the sources of each relation that should have one target, those with several."""
    n = edges.where(F.col("r").isin(single)).groupBy("s", "r").agg(F.count_distinct("t").alias("n"))
    bad = F.sum((F.col("n") > 1).cast("int"))
    return n.groupBy("r").agg(F.count(F.lit(1)).alias("groups"), bad.alias("contradictory"), F.round(1 - bad / F.count(F.lit(1)), 6).alias("score"))
