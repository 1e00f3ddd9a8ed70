"""Iterative graph measures on edge tables (src, dst). Each round is written out: plans stay short and a lost
executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorlake.session import discard, written

DAMPING = 0.85
#: Edges that a task writes at most, about; small rounds don't pay for many tasks and files.
EDGES_A_TASK = 1_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. A large star ties a node's larger neighbours to the smallest node around it, a
    small star its smaller ones. A hub's edges meet one row of it, in a join that adaptive execution splits."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        return near.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    edges: two columns of one orderable type, in either order, repeats and loops allowed. A node with loops only
    is left out, as are nulls. Rounds grow in number with the logarithm of the longest path; each is written, so
    a lost executor costs one, and the one before is deleted.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, then = state, now
        tasks = 1 + state[0] // EDGES_A_TASK  # rounds never have more edges than the one before
        now = written(_star(_star(now, large=True), large=False).coalesce(tasks))
        discard(then)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that can be reached."""
    nodes = _both_ways(edges).select("u").distinct()
    return nodes.join(rooted(edges.select("src", "dst")).withColumnRenamed("node", "u"), "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("component"))


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count("*").alias("size"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): all edges count, over the number of other nodes."""
    degrees = _both_ways(edges).groupBy("u").agg(F.count("*").alias("degree"))
    return degrees.crossJoin(F.broadcast(degrees.agg(F.count("*").alias("n")))).select(F.col("u").alias("node"), "degree", (F.col("degree") / F.nullif(F.col("n") - 1, F.lit(0))).alias("centrality"))


def pagerank(edges: DataFrame, tolerance: float = 1e-6, most: int = 100, every: int = 5) -> DataFrame:
    """(node, rank): undirected, parallel edges add weight; until a round changes the ranks by less than
    ``tolerance`` a node in sum, or ``most`` rounds.

    Starts from ranks in proportion to the degree, which a graph of two sides is close to already. The change is
    looked at when a round is written, every few rounds.
    """
    weights = written(_both_ways(edges).groupBy("u", "v").agg(F.count("*").alias("w")))
    out = written(weights.groupBy("u").agg(F.sum("w").alias("out")))
    whole = out.agg(F.sum("out").alias("total"), F.count("*").alias("n")).first()
    if not whole.n:
        return out.select(F.col("u").alias("node"), F.lit(0.0).alias("rank"))
    rank = out.select("u", (F.col("out") / whole.total).alias("rank"))
    old = None
    for i in range(most):
        sent = weights.join(rank.join(out, "u").select("u", (F.col("rank") / F.col("out")).alias("each")), "u")
        got = sent.groupBy(F.col("v").alias("u")).agg(F.sum(F.col("w") * F.col("each")).alias("got"))
        before, rank = rank, got.select("u", (F.lit((1 - DAMPING) / whole.n) + DAMPING * F.col("got")).alias("rank"))
        if (i + 1) % every == 0:
            rank = written(rank.join(before.withColumnRenamed("rank", "before"), "u"))
            moved = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
            rank = rank.select("u", "rank")
            if old is not None:
                discard(old)
            old = rank
            if moved < tolerance * whole.n:
                break
    discard(weights, out)
    return rank.select(F.col("u").alias("node"), "rank")


def top_subgraph(edges: DataFrame, count: int = 200) -> DataFrame:
    """The edges among the nodes of most edges."""
    best = degree_centrality(edges).orderBy(F.desc("degree"), "node").limit(count).select("node")
    return edges.join(best.withColumnRenamed("node", "src"), "src", "left_semi").join(best.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def largest_edge_score(scored: DataFrame) -> DataFrame:
    """(reviewer_user_id, max_score) of scored reviews."""
    return scored.groupBy("reviewer_user_id").agg(F.max("suspicion_score").alias("max_score"))


def suspicious_graph(scored: DataFrame, place: str = "place_id") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of flagged reviews alone, for where no whole graph is at hand: edges carry the score,
    vertices of reviewers the largest one of theirs."""
    from candorlake.operators.network import edges as edges_of
    from candorlake.operators.network import vertices as vertices_of

    rows = scored.filter("is_suspicious")
    edge = edges_of(rows, place).join(rows.select("review_id", "suspicion_score"), "review_id")
    largest = edge.groupBy(F.col("src").alias("node")).agg(F.max("suspicion_score").alias("max_score"))
    return vertices_of(edge).join(largest, "node", "left"), edge


def drawn_edges(edges: DataFrame, above: int = 500, count: int = 200) -> DataFrame:
    """The edges of a graph of up to ``above`` nodes, else those among its nodes of most edges."""
    return edges if _both_ways(edges).agg(F.count_distinct("u")).first()[0] <= above else top_subgraph(edges, count)
