"""Reducing a road network to its largest strongly connected part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, checkpointed_with_any


def least_reaching(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the first node from which it can be reached, itself included, as (rank, node).

    The order is by ``ranks`` (node, rank), then by node. Labels go along the edges, and from a node's label's own label to the
    node: what reaches a node's label reaches the node too. So they jump ahead. Every round is two joins by node.
    """
    # with ranks, nodes without edges may have a row too, and keep their own label
    start = ranks if ranks is not None else edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("rank", F.lit(0).cast("long"))
    labels = checkpointed(start.select("node", F.struct("rank", "node").alias("label")))
    kind = labels.schema["label"].dataType
    while True:
        along = labels.join(edges, labels["node"] == edges["a"]).select(F.col("b").alias("node"), "label", F.lit(None).cast(kind).alias("old"))
        new = along.unionByName(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        ahead = labels.select(F.col("node").alias("n"), F.col("label").alias("further"))
        # labels of labels may be the last round's: the next one sees the new
        jumped = new.join(ahead, F.col("label.node") == F.col("n")).select("node", F.least("label", "further").alias("label"), "old")
        jumped, changed = checkpointed_with_any(jumped, F.col("label") != F.col("old"))
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _between(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges`` between the nodes' names (node, name), each once and without loops; edges of nodes without a name fall away."""
    one = names.select(F.col("node").alias("a"), F.col("name").alias("na"))
    two = names.select(F.col("node").alias("b"), F.col("name").alias("nb"))
    return edges.join(one, "a").join(two, "b").where("na != nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()


def biggest_component(labels: DataFrame) -> DataFrame:
    """(component, n) of the most nodes; the smallest component among equals."""
    return labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)


#: Nodes are contracted, or trimmed, in steps that take at least this share of those left; labels do the rest.
WORTH = 0.05


def chain_ends(chains: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, head, tail) of nodes on open chains, (node, component) of those on closed ones, and the rounds that it took.

    ``chains``: node, pred, succ, the only neighbours of nodes with one link in and one out. ``head`` and ``tail`` are the first nodes behind and ahead that are
    none of these. Every node points ahead and behind, and in a round each pointer moves on to where the node it points to points: so
    pointers reach twice as far, and rounds grow with the logarithm of the longest chain. Pointers of a ring never leave it; its
    smallest node, which they meet on the way, names it.
    """
    inner = lambda df, end: df.join(chains.select(F.col("node").alias(end)).withColumn(f"{end}_in", F.lit(True)), end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", F.lit(False)))
    state = inner(inner(chains.select("node", F.col("pred").alias("head"), F.col("succ").alias("tail")), "head"), "tail").withColumns({"low": F.col("node"), "moved": F.lit(True)})
    state, rounds = checkpointed(state), 0
    while True:
        ahead = state.select(F.col("node").alias("tail"), F.col("tail").alias("t2"), F.col("tail_in").alias("t2_in"), F.col("low").alias("l2"))
        behind = state.select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("head_in").alias("h2_in"))
        jumped = state.join(ahead, "tail", "left").join(behind, "head", "left")
        moved = jumped.select(
            "node",
            F.coalesce("h2", "head").alias("head"), F.coalesce("h2_in", "head_in").alias("head_in"), F.coalesce("t2", "tail").alias("tail"), F.coalesce("t2_in", "tail_in").alias("tail_in"),
            F.least("low", F.coalesce("l2", "low")).alias("low"),
            # a node with an end outside is on an open chain; on a ring only the smallest node still changes
            (F.col("head_in") & ~F.coalesce("h2_in", F.lit(False)) | F.col("tail_in") & ~F.coalesce("t2_in", F.lit(False)) | (F.coalesce("l2", "low") < F.col("low"))).alias("moved"),
        )
        state, going = checkpointed_with_any(moved, F.col("moved"))
        rounds += 1
        if not going:
            open_ = ~F.col("head_in") & ~F.col("tail_in")
            return state.where(open_).select("node", "head", "tail"), state.where(~open_).select("node", F.col("low").alias("component")), rounds


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, list[tuple[DataFrame, DataFrame]]]:
    """(edges that are left, their nodes with n_in and n_out, how many these are, the chains and rings taken out in each step, as by ``chain_ends``).

    A step takes out nodes without a link in or out, each of which is a component of its own, and replaces chains of nodes with one link in and one out by a link from
    end to end. Trees vanish in steps that grow with the logarithm of their depth. Steps go on while they take enough nodes (``WORTH``).
    """
    steps: list[tuple[DataFrame, DataFrame]] = []
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(None).cast(edges.schema["a"].dataType).alias("pred"), F.col("b").alias("succ")), F.struct(F.col("b").alias("node"), F.col("a").alias("pred"), F.lit(None).cast(edges.schema["a"].dataType).alias("succ")))).alias("e")).select("e.*")
        # every link is there once, so a node's links are its neighbours
        degrees = checkpointed(ends.groupBy("node").agg(F.count("pred").alias("n_in"), F.count("succ").alias("n_out"), F.min("pred").alias("pred"), F.min("succ").alias("succ")))
        trim, chain = "n_in = 0 or n_out = 0", "n_in = 1 and n_out = 1"
        n = degrees.agg(F.count("*").alias("all"), F.count(F.when(F.expr(trim), 1)).alias("trim"), F.count(F.when(F.expr(chain), 1)).alias("chain")).first()
        if not n["all"] or n["trim"] + n["chain"] < max(1, WORTH * n["all"]):
            return edges, degrees, n["all"], steps
        gone = degrees.where(f"({trim}) or ({chain})").select("node")
        left = edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        if n["chain"]:
            chains = degrees.where(chain).select("node", "pred", "succ")
            opened, rings, _ = chain_ends(chains)
            steps.append((opened, rings))
            # a chain's last node stands for it; ends that were trimmed take their link with them
            last = opened.join(chains.select("node", "succ"), "node").where("succ = tail and head != tail")
            trimmed = degrees.where(trim).select("node")
            new = last.select(F.col("head").alias("a"), F.col("tail").alias("b")).join(trimmed.withColumnRenamed("node", "a"), "a", "left_anti").join(trimmed.withColumnRenamed("node", "b"), "b", "left_anti")
            left = left.unionByName(new.select("a", "b")).distinct()
        edges = checkpointed(left)


def strong_components(nodes: DataFrame, links: DataFrame, only_largest: bool = False) -> DataFrame:
    """(node, component) of every node; a component, in which all nodes reach each other, is named after its smallest node.

    Links in both directions make their ends one node first, which most streets of a road network do; then nodes without a way in or out go, and chains
    become single links (``contracted``). Then every node gets, of the nodes that reach it, the one with the most links, in times out, which is likely to be in
    the largest component. Where that node is reached in turn, without leaving those of the same label, both are in one component: so all labels are
    pivots at once. Components found are taken out, and this goes on with the rest. A chain is in its ends' component if they share one.
    With ``only_largest`` it ends when fewer nodes are left than the best component has; the rest then counts as single nodes.
    """
    every = nodes.select(F.col("node_id").alias("node")).unionByName(links.select(F.explode(F.array("from_node", "to_node")).alias("node"))).where("node is not null").distinct()
    edges = checkpointed(links.where("from_node != to_node").select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct())
    pairs = edges.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("links"), F.count(F.when(F.col("n") == 2, 1)).alias("streets")).first()
    names, weights = every.select("node", F.col("node").alias("name")), None
    if 2 * pairs["streets"] >= max(1, WORTH * (pairs["links"] or 0)):
        twins = least_reaching(checkpointed(edges.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")))
        names = checkpointed(every.join(twins, "node", "left").select("node", F.coalesce("label.node", "node").alias("name")))
        weights = names.groupBy("name").agg(F.count("*").alias("n")).withColumnRenamed("name", "node")
        edges = checkpointed(_between(edges, names))

    def weighed(some: DataFrame) -> DataFrame:
        """``some`` (node) with the number n of nodes that each stands for."""
        return some.withColumn("n", F.lit(1)) if weights is None else some.join(weights, "node")

    def largest(own: DataFrame) -> int:
        return weighed(own).groupBy("component").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0

    left, degrees, n_left, steps = contracted(edges)
    found: DataFrame | None = None
    for _, rings in steps:
        found = rings if found is None else found.unionByName(rings)
    best = hidden = 0
    if only_largest:
        best = 1 if weights is None else weights.agg(F.max("n")).first()[0] or 0
        best = max(best, largest(found)) if found is not None else best
        # chains may belong to what is left
        hidden = sum(weighed(opened).agg(F.sum("n")).first()[0] or 0 for opened, _ in steps)
    while n_left:
        if only_largest and (weighed(degrees).agg(F.sum("n")).first()[0] if weights is not None else n_left) + hidden < best:
            break
        ranks = degrees.select("node", (-F.col("n_in") * F.col("n_out")).alias("rank"))
        colours = least_reaching(left, ranks)
        inner = left.join(colours.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(colours.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b")
        back = least_reaching(checkpointed(inner.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))), ranks)
        # a label comes first among its nodes, so what reaches it has it as the first that it reaches; one without inner links is alone
        reached = colours.join(back.select("node", F.col("label.node").alias("reached")), "node", "left").where("coalesce(reached, node) = label.node")
        own = checkpointed(reached.select("node", F.col("label.node").alias("component")))
        found = own if found is None else found.unionByName(own)
        best = max(best, largest(own)) if only_largest else best
        gone = own.select("node")
        left = checkpointed(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        degrees = checkpointed(ends.groupBy("node").agg(F.sum(1 - F.col("out")).alias("n_in"), F.sum("out").alias("n_out")))
        n_left = degrees.count()
    # the chains taken out last hang on what was left then, so they come first
    for opened, _ in reversed(steps):
        known = found if found is not None else opened.select("node", F.col("node").alias("component")).limit(0)
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: B023, E731
        both = opened.join(of("head"), "head", "left").join(of("tail"), "tail", "left")
        own, other = F.coalesce("of_head", "head"), F.coalesce("of_tail", "tail")
        found = checkpointed(known.unionByName(both.select("node", F.when(own == other, own).otherwise(F.col("node")).alias("component"))))
    if found is None:
        return names.select("node", F.col("name").alias("component"))
    pivoted = checkpointed(names.join(found.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("component", "name").alias("pivot")))
    # written before it is joined, so that a component with most nodes can be split
    smallest = checkpointed(pivoted.groupBy("pivot").agg(F.min("node").alias("component")))
    return pivoted.join(smallest, "pivot").select("node", "component")


def largest_scc(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node) of the largest set of nodes that all reach each other; ties go to the smallest node."""
    labels = strong_components(nodes, links, only_largest=True)
    return labels.join(F.broadcast(biggest_component(labels)), "component", "left_semi").select("node")


def restrict_network(nodes: DataFrame, links: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in ``keep`` (node) and the links between them."""
    inside = links.join(keep.withColumnRenamed("node", "from_node"), "from_node", "left_semi").join(keep.withColumnRenamed("node", "to_node"), "to_node", "left_semi")
    return nodes.join(keep.withColumnRenamed("node", "node_id"), "node_id", "left_semi"), inside.select(*links.columns)


def clean_network(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network's largest strongly connected part."""
    return restrict_network(nodes, links, checkpointed(largest_scc(nodes, links)))
