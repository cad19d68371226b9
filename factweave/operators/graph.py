"""Graph operators as rounds of joins, each round cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.sources.rounds import settle


#: Ways to follow ``edges(a, b)``, "a needs b": from a node to what it needs, or to what needs it.
DIRECTIONS = ("prerequisite", "follow_up")


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int, max_nodes: int, direction: str = "prerequisite", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from many roots at once, ``root`` kept as a key: ``(nodes, links)``.

    ``nodes(root, node, depth)`` has the least depth. ``links(root, a, b, depth, cycle)`` lists each
    edge out of a visited node in the ``direction``, also to nodes seen before; it closes a cycle if its target is on the
    path by which its source was reached. Nodes beyond ``max_nodes`` per root, in the order of depth,
    parent's order and id, are left out. A target that is not one of ``known(node)``, where that is given, has links but is
    no node and isn't followed. Repeated edges and roots count once, null ones not at all.

    A root's nodes, in that order and with their parents' numbers, are arrays in one row, which travels with the root's
    next nodes to their neighbours and back: no depth compares with the earlier ones by a join. Nodes hand on their first
    ``max_nodes`` neighbours only, as a root can't take more, so that a hub's neighbours never meet; links come from all edges in the end.
    """
    edges, near = _ways(edges, max_depth, max_nodes, direction, known)
    walked = settle(_walk(near, roots, edges.schema["a"].dataType, max_depth, max_nodes))
    return walked.select("root", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("depths").alias("depth")))), _links(walked, edges, max_depth)


def _ways(edges: DataFrame, max_depth: int, max_nodes: int, direction: str, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The edges in the ``direction``, and each node's first known neighbours ``(a, to)``, settled both; one more than the budget tells a hub."""
    if not 0 <= max_depth <= 20 or not 1 <= max_nodes <= 500:
        raise ValueError("depth is 0 to 20, nodes 1 to 500")
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    a, b = ("a", "b") if direction == "prerequisite" else ("b", "a")
    edges = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct())
    to = edges if known is None else edges.join(known.select(F.col("node").alias("b")), "b", "left_semi")
    to = to.withColumn("_nth", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("_nth") <= max_nodes + 1)
    return edges, settle(to.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("to")))


#: Depths walked before the rows are settled and looked at for whether any root goes on.
AT_A_TIME = 7


def _walk(near: DataFrame, roots: DataFrame, kind: T.DataType, max_depth: int, max_nodes: int) -> DataFrame:
    """``(root, nodes, parents, depths, live)``: a root's nodes as they are reached, their parents' positions (0: none) and depths, and where the last depth begins."""
    rows = _start(roots, kind)
    for depth in range(1, max_depth + 1):
        rows = _taken(_asked(rows, near, ["to"]), max_nodes).select("root", *_longer(depth))
        if depth % AT_A_TIME == 0 and depth < max_depth:
            rows = settle(rows)
            if rows.filter(F.col("live") <= F.size("nodes")).isEmpty():
                break
    return rows


def _start(roots: DataFrame, kind: T.DataType) -> DataFrame:
    root = F.array(F.col("root").cast(kind)).alias("nodes")
    return roots.select("root").dropna().distinct().select("root", root, F.array(F.lit(0)).alias("parents"), F.array(F.lit(0)).alias("depths"), F.lit(1).alias("live"))


def _asked(rows: DataFrame, near: DataFrame, said: list[str]) -> DataFrame:
    """``(root, came, own)``: what ``near`` says of each node of the last depth, in their order, and the root's row, which went along with the first of them.

    A root without such nodes goes to its own node's task and gets nothing.
    """
    state = [c for c in rows.columns if c != "root"]
    last = F.slice("nodes", F.col("live"), F.greatest(F.size("nodes") - F.col("live") + 1, F.lit(0)))
    out = rows.select("root", *state, F.posexplode_outer(last).alias("_i", "_node"))
    out = out.select("root", (F.col("live") + F.col("_i")).alias("at"), F.coalesce("_node", F.col("nodes")[0]).alias("_node"), F.when(F.coalesce("_i", F.lit(0)) == 0, F.struct(*state)).alias("own"))
    out = out.join(near, out["_node"] == near["a"], "left")
    told = F.when(F.col("at").isNotNull() & F.col("a").isNotNull(), F.struct("at", *said))
    return out.groupBy("root").agg(F.sort_array(F.collect_list(told)).alias("came"), F.first("own", ignorenulls=True).alias("own"))


def _taken(came: DataFrame, max_nodes: int) -> DataFrame:
    """With ``_t``: the root's nodes and their parents after what came in."""
    before = F.struct(F.col("own.nodes").alias("nodes"), F.col("own.parents").alias("parents"))
    return came.withColumn("_t", F.aggregate("came", before, lambda acc, x: _joined(acc, x, max_nodes)))


def _longer(depth: int) -> list[Column]:
    """The root's row after a depth."""
    depths = F.concat("own.depths", F.array_repeat(F.lit(depth), F.size("_t.nodes") - F.size("own.nodes")))
    return [F.col("_t.nodes"), F.col("_t.parents"), depths.alias("depths"), (F.size("own.nodes") + 1).alias("live")]


def _joined(acc: Column, x: Column, max_nodes: int) -> Column:
    """The nodes so far and a node's neighbours that are new, with its position as their parent, up to the budget."""
    new = F.slice(F.array_except(x["to"], acc["nodes"]), F.lit(1), F.lit(max_nodes) - F.size(acc["nodes"]))
    return F.struct(F.concat(acc["nodes"], new).alias("nodes"), F.concat(acc["parents"], F.array_repeat(x["at"], F.size(new))).alias("parents"))


def _paths(kind: T.DataType) -> Column:
    """For each of ``nodes`` the path by which it was reached, from itself up to the root."""
    longer = lambda acc, i: F.concat(F.array(F.col("nodes")[i - 1]), F.coalesce(F.get(acc, F.col("parents")[i - 1] - 1), F.array().cast(T.ArrayType(kind))))
    return F.aggregate(F.sequence(F.lit(1), F.size("nodes")), F.array().cast(T.ArrayType(T.ArrayType(kind))), lambda acc, i: F.concat(acc, F.array(longer(acc, i))))


def _links(walked: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Edges out of visited nodes above the last depth; a target on the node's own path closes a cycle."""
    rows = walked.select("root", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("depths").alias("depth"), _paths(edges.schema["a"].dataType).alias("path"))))
    out = rows.filter(F.col("depth") < max_depth).join(edges, rows["node"] == edges["a"])
    return out.select("root", "a", "b", (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("b")).alias("cycle"))


def traversal_flags(nodes: DataFrame, links: DataFrame, edges: DataFrame, max_depth: int, known: DataFrame | None = None, partial: DataFrame | None = None, direction: str = "prerequisite") -> DataFrame:
    """Per root: how many nodes, the deepest, and what has to be said about the result.

    ``ambiguous``: a node had more than one neighbour. ``cycle``: a link leads back onto its path.
    ``unresolved``: a link's target is not among ``known(node)``. ``incomplete``: a visited node's own set
    is one of ``partial(node)``. ``truncated_by_depth``: a node at the last depth has neighbours.
    ``truncated_by_budget``: a link's target was left out for the number of nodes. ``direction`` is the walk's.
    """
    per = nodes.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"))
    branch = links.groupBy("root", "a").agg(F.count("*").alias("n"), F.bool_or("cycle").alias("cycle"))
    branch = branch.groupBy("root").agg(F.bool_or(F.col("n") > 1).alias("ambiguous"), F.bool_or("cycle").alias("cycle"))
    roots_of = lambda rows, name: rows.select("root").distinct().withColumn(name, F.lit(True))
    flags = [roots_of(nodes.filter(F.col("depth") == max_depth).join(edges.select(F.col("a" if direction == "prerequisite" else "b").alias("node")), "node", "left_semi"), "truncated_by_depth")]
    flags.append(roots_of(links.join(nodes.select("root", F.col("node").alias("b")), ["root", "b"], "left_anti"), "truncated_by_budget"))
    if known is not None:
        flags.append(roots_of(links.join(known.select(F.col("node").alias("b")), "b", "left_anti"), "unresolved"))
    if partial is not None:
        flags.append(roots_of(nodes.join(partial.select("node"), "node", "left_semi"), "incomplete"))
    out = per.join(branch, "root", "left")
    for flag in flags:
        out = out.join(flag, "root", "left")
    return out.select("root", "nodes", "deepest", *[F.coalesce(c, F.lit(False)).alias(c) for c in out.columns if c not in ("root", "nodes", "deepest")])


def walk_flags(edges: DataFrame, roots: DataFrame, max_depth: int, max_nodes: int, known: DataFrame | None = None, partial: DataFrame | None = None, direction: str = "prerequisite") -> DataFrame:
    """``traversal_flags`` of a walk over all edges, found while walking: neither nodes nor links become rows.

    What is said of a node (a target isn't known, its set is partial) comes along with its neighbours; one more
    step asks the nodes at the last depth. Only hubs, with more neighbours than the budget, are held against all their edges, for cycles.
    """
    edges, near = _ways(edges, max_depth, max_nodes, direction, None)
    kind = edges.schema["a"].dataType
    if known is not None:
        lost = edges.join(known.select(F.col("node").alias("b")), "b", "left_anti").select("a").distinct()
        near = near.join(lost.withColumn("unresolved", F.lit(True)), "a", "left")
    if partial is not None:
        near = near.join(partial.select(F.col("node").alias("a")).distinct().withColumn("incomplete", F.lit(True)), "a", "full_outer")
    notes = [c for c in ("unresolved", "incomplete") if c in near.columns]
    near = settle(near.select("a", F.coalesce("to", F.array().cast(T.ArrayType(kind))).alias("to"), *(F.coalesce(c, F.lit(False)).alias(c) for c in notes)))
    found = ["ambiguous", "cycle", "truncated_by_budget", *notes]
    some = lambda c, said: (F.col(f"own.{c}") | F.exists("came", said)).alias(c)
    rows = _start(roots, kind).select("*", *(F.lit(False).alias(c) for c in found))
    for depth in range(1, max_depth + 1):
        says = {
            "ambiguous": lambda x: F.size(x["to"]) > 1,
            "cycle": lambda x: F.arrays_overlap(x["to"], _way_up(x["at"], depth, kind)),  # noqa: B023
            "truncated_by_budget": lambda x: F.size(F.array_except(x["to"], F.col("_t.nodes"))) > 0,
            "unresolved": lambda x: x["unresolved"],
            "incomplete": lambda x: x["incomplete"],
        }
        rows = _taken(_asked(rows, near, ["to", *notes]), max_nodes).select("root", *_longer(depth), *(some(c, says[c]) for c in found))
        if depth % AT_A_TIME == 0 and depth < max_depth:
            rows = settle(rows)
            if rows.filter(F.col("live") <= F.size("nodes")).isEmpty():
                break
    wide = near.filter(F.size("to") > max_nodes).select(F.col("a").alias("node"))
    hubs = not wide.isEmpty()
    if hubs:
        rows = settle(rows)
        back = _links(rows, edges.join(wide.withColumnRenamed("node", "a"), "a", "left_semi"), max_depth).filter("cycle").select("root").distinct()
    goes = F.col("live") <= F.size("nodes")
    last = F.when(goes, F.slice("nodes", F.col("live"), F.greatest(F.size("nodes") - F.col("live") + 1, F.lit(0)))).otherwise(F.slice("nodes", 1, 1))
    ends = rows.select("root", last.alias("nodes"), F.when(goes, 1).otherwise(2).alias("live"), F.size("nodes").cast("long").alias("_n"), F.array_max("depths").alias("deepest"), *found)
    out = _asked(ends, near, ["to", *notes])
    more = {"truncated_by_depth": F.exists("came", lambda x: F.size(x["to"]) > 0)} | {c: some(c, lambda x: x["incomplete"]) if c == "incomplete" else F.col(f"own.{c}") for c in found}
    out = out.select("root", F.col("own._n").alias("nodes"), "own.deepest", *(c.alias(name) for name, c in more.items()))
    if hubs:
        out = out.join(back.withColumn("_back", F.lit(True)), "root", "left").withColumn("cycle", F.col("cycle") | F.coalesce("_back", F.lit(False))).drop("_back")
    return out


def _way_up(at: Column, length: int, kind: T.DataType) -> Column:
    """The ``length`` nodes from the node at a position up to the root."""
    nodes, parents = F.col("own.nodes"), F.col("own.parents")
    up = lambda s, _: F.struct(F.get(parents, s["p"] - 1).alias("p"), F.concat(s["way"], F.array(F.get(nodes, s["p"] - 1))).alias("way"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.struct(at.alias("p"), F.array().cast(T.ArrayType(kind)).alias("way")), up, lambda s: s["way"])


def _by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined by shuffle: a broadcast in every round would send all rounds' rows through the driver."""
    return rows.hint("merge")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an incoming or outgoing edge are trimmed again and again: what lies on or between cycles."""
    rest = settle(edges.filter("a <> b").select("a", "b").distinct())
    size = rest.count()
    while True:
        into, out = rest.select(F.col("b").alias("a")).distinct(), rest.select(F.col("a").alias("b")).distinct()
        rest = settle(rest.join(_by_shuffle(into), "a", "left_semi").join(_by_shuffle(out), "b", "left_semi").select("a", "b"))  # cut each time: every step names the last one thrice
        left = rest.count()
        if left == size:
            return rest
        size = left


def _reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least node that reaches each node along ``edges(a, b)`` within ``labels(node, part, label)``; only inside a part.

    Labels name nodes of the part, so what reaches a label reaches all that have it: after each step
    along the edges a node takes its label's label. Rounds grow with the logarithm of the longest way
    where labels fall along it.
    """
    seen = None
    while True:
        src = labels.select(F.col("node").alias("a"), F.col("part").alias("_pa"), "label")
        dst = labels.select(F.col("node").alias("b"), F.col("part").alias("_pb"))
        came = edges.join(_by_shuffle(src), "a").join(_by_shuffle(dst), "b").filter("_pa = _pb").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_l"))
        labels = settle(labels.join(_by_shuffle(came), "node", "left").select("node", "part", F.least("label", F.coalesce("_l", "label")).alias("label")))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("_l"))
        labels = settle(labels.join(_by_shuffle(of_label), "label").select("node", "part", F.least("label", "_l").alias("label")))
        now = tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "label"))).first())
        if now == seen:
            return labels
        seen = now


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of strongly connected components with more than one node, named by their least node.

    After trimming, each round colours nodes by the least node that reaches them; within a colour,
    those that it reaches backwards too (it is the least of its colour) form its component and leave. Every round
    names at least the component of each colour, so rounds end; no graph is gathered anywhere.
    """
    rest = cyclic_core(edges)
    done = None
    while rest.head(1):
        nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
        colour = _reach(rest, settle(nodes.select("node", F.lit(0).cast("long").alias("part"), F.col("node").alias("label"))))
        back = rest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        start = settle(colour.select("node", F.col("label").alias("part"), F.col("node").alias("label")))
        found = settle(_reach(back, start).filter("label = part").select("node", F.col("part").alias("component")))
        done = found if done is None else done.unionByName(found)
        rest = rest.join(_by_shuffle(found.select(F.col("node").alias("a"))), "a", "left_anti").join(_by_shuffle(found.select(F.col("node").alias("b"))), "b", "left_anti")
        rest = cyclic_core(rest)
    if done is None:
        return edges.limit(0).select(F.col("a").alias("node"), F.col("a").alias("component"))
    many = done.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return done.join(_by_shuffle(many), "component", "left_semi").select("node", "component")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("a = b").select(F.col("a").alias("node")).distinct()


def _mark(member: str) -> list[Column]:
    """Aggregates over distinct members that are alike for equal sets, and differ for different ones but for chance."""
    return [F.count("*").alias("_n"), F.bit_xor(F.xxhash64(member)).alias("_h"), F.bit_xor(F.xxhash64(F.lit("again"), F.col(member))).alias("_g")]


def set_classes(members: DataFrame, owner: str, member: str) -> DataFrame:
    """``(owner, class)``: owners have one class exactly if their sets of members are equal; it is named by one of them.

    Sets meet only as marks of fixed size. The members of owners with one mark are held against those of their
    least owner, member by member; who differs, which chance hardly allows, goes to another round. No set is gathered,
    and a round joins each member once.
    """
    members = settle(members.select(owner, member).filter(F.col(owner).isNotNull()).distinct())
    todo = settle(members.groupBy(owner).agg(*_mark(member)))
    done = None
    while True:
        marks = ["_n", "_h", "_g"]
        named = todo.join(todo.groupBy(*marks).agg(F.min(owner).alias("class")), marks).select(owner, "class", *marks)
        first = members.select(F.col(owner).alias("_o"), F.col(member).alias("_m"))
        checked = members.join(named.filter(F.col(owner) != F.col("class")).select(owner, "class"), owner)
        others = checked.join(first, (F.col("class") == F.col("_o")) & F.col(member).eqNullSafe(F.col("_m")), "left_anti")
        others = settle(others.select(owner).distinct())
        fine = named.select(owner, "class") if others.isEmpty() else named.join(others, owner, "left_anti").select(owner, "class")
        done = fine if done is None else done.unionByName(fine)
        if others.isEmpty():
            return settle(done)
        todo = todo.join(others, owner, "left_semi")


def group_consistency(members: DataFrame, owner: str, member: str) -> DataFrame:
    """Pairs of an owner and a member that is an owner itself, whose sets differ."""
    classes = set_classes(members, owner, member)
    l, r = classes.select(F.col(owner).alias("_o"), F.col("class").alias("_l")), classes.select(F.col(owner).alias("_m"), F.col("class").alias("_r"))
    named = members.filter(F.col(owner) != F.col(member)).select(F.col(owner).alias("_o"), F.col(member).alias("_m"))
    differ = named.join(r, "_m").join(l, "_o").filter("_l <> _r")
    return differ.select(F.least("_o", "_m").alias("left"), F.greatest("_o", "_m").alias("right")).distinct()
