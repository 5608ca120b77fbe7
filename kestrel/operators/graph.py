"""Entity graphs as two DataFrames.

``nodes(id, type, label)`` and ``edges(src, dst, relation, weight)``; an
undirected graph stores each edge in both directions.  Traversals are
iterative joins; lineage is cut with ``checkpoint()`` into the shared
checkpoint folder every round (never a local checkpoint).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.plans.distributed import written
from kestrel.session import checkpoint_dir


def node_id(kind: str, value) -> F.Column:
    return F.concat(F.lit(kind + ":"), F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))


def extract_entities(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """M1: distinct ``type:value`` nodes from table cells ({column: type})."""
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("label"))
                                for c, t in columns.items()])).alias("e")
    long = df.select(parts).select("e.*").where(F.col("label").isNotNull() & (F.trim("label") != ""))
    return long.distinct().select(F.concat_ws(":", "type", "label").alias("id"), "type", "label")


def star_graph(df: DataFrame, invoice: str, customer: str, product: str, date: str, amount: str | None = None,
               money_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M2/M3: invoice -> customer (sold_to), invoice -> product (contains),
    invoice -> date (occurred_on) and customer -> product (purchased), keyed
    on each row (the reference lost repeated rows).  Missing customers become
    'Unknown', missing products 'General'.  Amounts (or money text parsed with
    H5) are summed per invoice onto the invoice node."""
    cust = F.coalesce(F.col(customer).cast("string"), F.lit("Unknown"))
    prod = F.coalesce(F.col(product).cast("string"), F.lit("General"))
    inv = F.col(invoice).cast("string")
    day = F.date_format(F.col(date), "yyyy-MM-dd")
    amt = (scalars.parse_money(F.col(money_text))["amount"] if money_text else
           (F.col(amount).cast("double") if amount else F.lit(None).cast("double")))
    rows = df.select(inv.alias("inv"), cust.alias("cust"), prod.alias("prod"), day.alias("day"), amt.alias("amt"))
    rows = written(rows, "star")  # each kind of node and edge reads it
    e = F.explode(F.array(
        F.struct(F.concat(F.lit("invoice:"), "inv").alias("src"), F.concat(F.lit("customer:"), "cust").alias("dst"),
                 F.lit("sold_to").alias("relation")),
        F.struct(F.concat(F.lit("invoice:"), "inv").alias("src"), F.concat(F.lit("product:"), "prod").alias("dst"),
                 F.lit("contains").alias("relation")),
        F.struct(F.concat(F.lit("invoice:"), "inv").alias("src"), F.concat(F.lit("date:"), "day").alias("dst"),
                 F.lit("occurred_on").alias("relation")),
        F.struct(F.concat(F.lit("customer:"), "cust").alias("src"), F.concat(F.lit("product:"), "prod").alias("dst"),
                 F.lit("purchased").alias("relation"))))
    edges = rows.where(F.col("inv").isNotNull()).select(e.alias("e")).select("e.*").groupBy("src", "dst", "relation").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    nodes_parts = [
        rows.groupBy("inv").agg(F.sum("amt").alias("amount")).select(
            F.concat(F.lit("invoice:"), "inv").alias("id"), F.lit("invoice").alias("type"), F.col("inv").alias("label"), "amount"),
        rows.select("cust").distinct().select(F.concat(F.lit("customer:"), "cust").alias("id"), F.lit("customer").alias("type"),
                                              F.col("cust").alias("label"), F.lit(None).cast("double").alias("amount")),
        rows.select("prod").distinct().select(F.concat(F.lit("product:"), "prod").alias("id"), F.lit("product").alias("type"),
                                              F.col("prod").alias("label"), F.lit(None).cast("double").alias("amount")),
        rows.where(F.col("day").isNotNull()).select("day").distinct().select(
            F.concat(F.lit("date:"), "day").alias("id"), F.lit("date").alias("type"), F.col("day").alias("label"),
            F.lit(None).cast("double").alias("amount")),
    ]
    nodes = reduce(DataFrame.unionByName, nodes_parts)
    return nodes, edges


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (the reference's graph is undirected)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight")
    return edges.unionByName(rev)


def merge_graphs(graphs: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes unioned by id, attributes of the later graph win; edges
    distinct on (src, dst, relation) keeping the later weight."""
    nodes = reduce(DataFrame.unionByName, [n.withColumn("_g", F.lit(i)) for i, (n, _) in enumerate(graphs)])
    attrs = [c for c in nodes.columns if c not in ("id", "_g")]
    # later graph wins for every attribute that it sets (null keeps the earlier value)
    merged = nodes.groupBy("id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_g"))).alias(c)
                                       for c in attrs])
    edges = reduce(DataFrame.unionByName, [e.withColumn("_g", F.lit(i)) for i, (_, e) in enumerate(graphs)])
    e2 = edges.groupBy("src", "dst", "relation").agg(F.max_by("weight", "_g").alias("weight"))
    return merged, e2


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M5: node and edge counts, density E / (N (N - 1)), average degree,
    isolated-node share (left anti join on edge endpoints)."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    e = edges.agg(F.count(F.lit(1))).scalar()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # from one look at the edges
    iso = nodes.join(ends, "id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return nodes.sparkSession.range(1).select(n.alias("nodes"), e.alias("edges"), (e / (n * (n - 1))).alias("density"),
                      (2.0 * e / n).alias("avg_degree"), (iso * 100.0 / n).alias("isolated_pct"))


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    """M5: node count per type."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M5: (id, out_degree, in_degree, degree) of every node, isolated ones with zeros.  Ends
    are counted before the join, so a hub is one row there; ends that are no node are left out."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                          F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    d = nodes.select("id").join(n, "id", "left").select(
        "id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))
    return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def revenue_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M6: one row per invoice node: customer, product and date (the label of its neighbour of
    that type; of several the last by label), the amount, and what stands for a missing one.
    Invoices without a positive amount, customer and product are left out."""
    inv = nodes.where(F.col("type") == "invoice").select(F.col("id").alias("invoice"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    ends = nodes.where(F.col("type").isin("customer", "product", "date")).select(
        F.col("id").alias("dst"), "type", F.col("label").cast("string").alias("label"))
    nb = edges.select(F.col("src").alias("invoice"), "dst").join(ends, "dst").groupBy("invoice").agg(
        *[F.max(F.when(F.col("type") == t, F.col("label"))).alias(t) for t in ("customer", "product", "date")])
    j = inv.join(nb, "invoice", "left").where((F.col("amount") > 0) | F.col("customer").isNotNull() | F.col("product").isNotNull())
    return j.select("invoice", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (
        ("customer", "Unknown Customer"), ("product", "General Item"), ("date", "Unknown Date"))], "amount")


def flatten_star(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per invoice with its customer, product(s) and date
    (neighbour join, pivoted by neighbour type) and the invoice amount."""
    inv = nodes.where(F.col("type") == "invoice").select(F.col("id").alias("src"), F.col("label").alias("invoice"), "amount")
    nb = edges.join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("ntype"), F.col("label").alias("nlabel")), "dst")
    j = inv.join(nb, "src")
    return j.groupBy("invoice", "amount").pivot("ntype", ["customer", "product", "date"]).agg(
        F.array_sort(F.collect_set("nlabel")))


def match_nodes(nodes: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """M7: nodes whose lower-case id or label contains any pattern, or whose
    type equals it."""
    cond = reduce(lambda a, b: a | b, [F.lower("id").contains(p.lower()) | F.lower("label").contains(p.lower())
                                       | (F.col("type") == p) for p in patterns])
    return nodes.where(cond)


def _written(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100,
             weighted: bool = True, iterations: int | None = None) -> DataFrame:
    """M8: weighted PageRank on the given directed edge list: the mass of nodes
    without out-edges is spread evenly, ranks sum to 1.  Rounds run until the ranks
    change by less than ``tolerance`` a node in all; not reaching that within
    ``max_iterations`` is an error; ``iterations`` asks for that many rounds at most
    and takes the ranks as they then are.  A round is one join and aggregate, written,
    and one aggregate (change and dangling mass, one row) to the driver."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = edges.select("src", "dst", w.cast("double").alias("w"))
    out_w = e.groupBy("src").agg(F.sum("w").alias("_ow"))
    e = _written(e.join(out_w, "src").groupBy("src", "dst").agg(F.sum(F.col("w") / F.col("_ow")).alias("p")))
    ids = nodes.select("id").distinct()
    start = ids.join(e.select(F.col("src").alias("id"), F.lit(True).alias("_out")).distinct(), "id", "left").select(
        "id", F.coalesce("_out", F.lit(False)).alias("_out"))
    start = _written(start)
    n, idle = start.agg(F.count(F.lit(1)), F.count_if(~F.col("_out"))).first()
    ranks = start.withColumn("rank", F.lit(1.0 / max(n, 1)))
    dangling = idle / max(n, 1)
    for _ in range(max_iterations if iterations is None else iterations):
        contrib = ranks.select(F.col("id").alias("src"), "rank").join(e, "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") * F.col("p")).alias("_in"))
        base = (1 - damping + damping * dangling) / max(n, 1)
        ranks = _written(ranks.join(contrib, "id", "left").select(
            "id", "_out", F.col("rank").alias("_before"), (F.lit(base) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank")))
        change, dangling = ranks.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_before"))), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~F.col("_out"), F.col("rank"))), F.lit(0.0))).first()
        ranks = ranks.drop("_before")
        if change < tolerance * n or n == 0:
            return ranks.select("id", "rank")
    if iterations is not None:
        return ranks.select("id", "rank")
    raise ValueError(f"ranks still change by {change} after {max_iterations} rounds")


def top_neighbours(edges: DataFrame, ranks: DataFrame, node: str, n: int = 10) -> DataFrame:
    """Neighbours of ``node`` ranked by PageRank."""
    nb = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation").distinct()
    return nb.join(ranks, "id").orderBy(F.desc("rank"), "id").limit(n)


NEAR_ROWS = 200_000  # a frontier of up to so many rows goes to every task


def bfs(edges: DataFrame, source: str, max_hops: int = 3, targets: Sequence[str] | None = None) -> DataFrame:
    """Breadth-first discovery tree from ``source`` up to ``max_hops``:
    (id, hops, parent, path).  The parent of a node is the smallest parent id
    at its discovery hop.  With ``targets`` only those nodes are returned.

    A hop needs only the edges that leave its frontier, whose rows are counted.  Up to
    ``NEAR_ROWS`` of them are broadcast in a semi join, which Spark moves below the unions and
    aggregates that make the edges, so that no other edge is shuffled or written.  From the first
    larger frontier on the edges are written as a table, once, and joined by shuffle."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e, table = edges.select("src", "dst"), None
    visited = spark.createDataFrame([(source, 0, None, [source])], "id string, hops int, parent string, path array<string>")
    frontier, n = visited, 1
    for h in range(1, max_hops + 1):
        ids = frontier.select(F.col("id").alias("src"))
        if n <= NEAR_ROWS:
            near = (e if table is None else table).join(F.broadcast(ids), "src", "left_semi")  # a counted bound
        else:
            table = written(e, "edges") if table is None else table
            near = table.join(ids, "src", "left_semi")
        nxt = near.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        nxt = nxt.join(visited.select("id"), "id", "left_anti")
        nxt = nxt.join(frontier.select(F.col("id").alias("parent"), "path"), "parent").select(
            "id", F.lit(h).alias("hops"), "parent", F.concat("path", F.array("id")).alias("path"))
        nxt = nxt.checkpoint(eager=True)
        n = nxt.count()
        visited = visited.unionByName(nxt)
        frontier = nxt
    if targets:
        visited = visited.where(F.col("id").isin(list(targets)))
    return visited


def simple_paths(edges: DataFrame, source: str, target: str, max_hops: int = 3) -> DataFrame:
    """Every cycle-free path from ``source`` to ``target`` with at most
    ``max_hops`` edges (all of them, deterministic order by path)."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    cur = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    found = []
    for h in range(1, max_hops + 1):
        nxt = cur.select(F.col("id").alias("src"), "path").join(e, "src").where(~F.array_contains("path", F.col("dst")))
        nxt = nxt.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.checkpoint(eager=True)
        found.append(nxt.where(F.col("id") == target).select("path", F.lit(h).alias("hops")))
        cur = nxt.where(F.col("id") != target)
    return reduce(DataFrame.unionByName, found)


def shortest_path(edges: DataFrame, source: str, target: str | None = None, max_hops: int | None = None) -> DataFrame:
    """Minimum-weight paths from ``source`` (weight default 1): rounds of a
    join from the nodes that the last round improved, until none improves.  A
    negative weight is an error, so rounds end.  Paths longer than ``max_hops``
    edges are dropped *after* the search."""
    spark = edges.sparkSession
    e = edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))
    e = _written(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    if e.where(F.col("w") < 0).limit(1).count():
        raise ValueError("shortest_path needs weights of 0 or more")
    best = spark.createDataFrame([(source, 0.0, [source], True)], "id string, dist double, path array<string>, fresh boolean")
    while True:
        step = best.where("fresh").select(F.col("id").alias("src"), "dist", "path").join(e, "src").select(
            F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"),
            F.concat("path", F.array("dst")).alias("path"), F.lit(True).alias("fresh"))
        known = best.withColumn("fresh", F.lit(False))
        order = F.struct("dist", F.size("path"), "path", "fresh")  # an equal path keeps its known row
        best = _written(known.unionByName(step).groupBy("id").agg(F.min_by(F.struct("dist", "path", "fresh"), order).alias("b"))
                        .select("id", "b.*"))
        if not best.where("fresh").limit(1).count():
            break
    out = best.drop("fresh").withColumn("hops", F.size("path") - 1)
    if target is not None:
        out = out.where(F.col("id") == target)
    if max_hops is not None:
        out = out.where(F.col("hops") <= max_hops)
    return out


def importance_walk(edges: DataFrame, ranks: DataFrame, start: str, steps: int = 5) -> DataFrame:
    """From ``start`` move ``steps`` times to the unvisited neighbour of the
    highest PageRank (ties: smallest id); returns (step, id, rank).  The walk is a
    one-row frame extended by a join and an aggregate a step."""
    spark = edges.sparkSession
    e = _written(edges.select("src", "dst").distinct().join(ranks.select(F.col("id").alias("dst"), "rank"), "dst"))
    at = spark.createDataFrame([(start, [start])], "src string, path array<string>")
    walk = [at]
    for _ in range(steps):
        ways = at.join(e, "src").where(~F.array_contains("path", F.col("dst")))
        pick = ways.groupBy("path").agg(F.min_by("dst", F.struct(-F.col("rank"), F.col("dst"))).alias("src"))
        at = _written(pick.select("src", F.concat("path", F.array("src")).alias("path")))
        walk.append(at)
    rows = reduce(DataFrame.unionByName, walk).select((F.size("path") - 1).alias("step"), F.col("src").alias("id"))
    return rows.join(ranks, "id", "left").select("step", "id", "rank").orderBy("step")


def subgraph(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All nodes of the given types and all edges among them."""
    keep = nodes.where(F.col("type").isin(list(types)))
    ids = written(keep.select("id").distinct(), "ids")  # read for either end
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return keep, e


def correlation_graph(corr_pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Columns as nodes, |r| > threshold as weighted edges."""
    return corr_pairs.where(F.abs("r") > threshold).select(F.col("col_a").alias("src"), F.col("col_b").alias("dst"),
                                                          F.lit("correlated").alias("relation"), F.abs("r").alias("weight"))


def cooccurrence_graph(pairs: DataFrame) -> DataFrame:
    """Co-occurring value pairs (J7) as weighted edges."""
    return pairs.select(F.concat_ws(":", "col_a", "value_a").alias("src"), F.concat_ws(":", "col_b", "value_b").alias("dst"),
                        F.lit("co_occurs").alias("relation"), F.col("count").cast("double").alias("weight"))

