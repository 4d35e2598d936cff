"""Parent-child links to full hierarchies by pointer doubling.

State: of each node the ancestors at a walk of exactly 2^k links (active pointers) and the ends found within 2^k links
(resolved). A round joins pointers to the state of their targets, which doubles the distance, and concatenates path
segments. Nodes on cycles are found first: pointer doubling over the nodes with one parent takes away all that leads to
a root, the same over the nodes with one child all that leads to a leaf, until nothing more goes; what then stays
unresolved holds the cycles. Links above nodes on cycles are cut, so that all walks end and the pointers of a cyclic
block are never multiplied; its roots are found afterwards from the links that lead out of it.

Each scope is a graph of its own. Scopes of at most LOCAL links are solved whole, many in one task, by the same method
over arrays (forest.py); larger ones, paths and lists of all ancestors by joins, in which hot parents and labels are
salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.forest import NO_ROOT, ON_CYCLE, solver
from tidemark.operators.skew import ROWS, hot_keys, salted_join
from tidemark.session import materialize, release

SEP = "/"
LOCAL = 1 << 14


def _join(big: DataFrame, small: DataFrame, on: list[str], salt_on: list[str], how: str = "inner", rows: int | None = ROWS) -> DataFrame:
    """salted_join(), or a plain one (rows None) where all links together are too few for a hot key."""
    return big.join(small, on, how) if rows is None else salted_join(big, small, on, salt_on, how, rows)


def _trim(e: DataFrame, live: DataFrame, x: str, y: str, g: list[str], rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Links e (g, n, a) and nodes live (g, x) without the nodes x that have no link to a y, and without those whose one
    link leads, over nodes with one link, to such a node; again until there are none."""
    while not live.isEmpty():
        have = e.groupBy(*g, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("c"), F.min(y).alias("y"))
        st = live.join(have, [*g, "x"], "left")
        st = materialize(st.select(*g, "x", F.when(F.col("c") == 1, F.col("y")).otherwise(F.col("x")).alias("t"), F.when(F.col("c").isNull(), True).when(F.col("c") > 1, False).alias("free")))
        n, rounds = st.filter("free is null").count(), 0
        left = n
        while left and 2**rounds <= n:
            to = st.select(*g, F.col("x").alias("t"), F.col("t").alias("_t"), "free")
            new = _join(st.filter("free is null").select(*g, "x", "t"), to, [*g, "t"], ["x"], rows=rows).select(*g, "x", F.col("_t").alias("t"), "free")
            was, st, rounds = st, materialize(st.filter("free is not null").unionByName(new)), rounds + 1
            release(was)
            left = st.filter("free is null").count()
        gone = st.filter("free").select(*g, "x")
        if gone.isEmpty():
            break
        live = materialize(st.filter("not coalesce(free, false)").select(*g, "x"))
        e = materialize(_join(e, gone.withColumnRenamed("x", y), [*g, y], [x], "left_anti", rows=rows))
    return e, live


def _label(c: str) -> Column:
    """Labels are ordered by a hash, so that the least of them lies far off on the average, whatever the ids' order."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def _min_labels(edges: DataFrame, start: DataFrame, g: list[str], rows: int | None) -> DataFrame:
    """Of each node of start (g, x) the least label (m) of the nodes from which a walk along edges (g, a -> n) leads to
    it, and its own. A label is itself a node that reaches the row's node, so labels are followed too: rounds are
    logarithmic on long cycles. Linear in nodes and edges."""
    lab = materialize(start.select(*g, "x", _label("x").alias("m")))
    while True:
        over = _join(edges.select(*g, "a", "n"), lab.select(*g, F.col("x").alias("a"), "m"), [*g, "a"], ["n"], rows=rows).select(*g, F.col("n").alias("x"), "m")
        jump = _join(lab, lab.select(*g, _label("x").alias("m"), F.col("m").alias("_m")), [*g, "m"], ["x"], rows=rows).select(*g, "x", F.col("_m").alias("m"))
        new = materialize(lab.select(*g, "x", "m").unionByName(over).unionByName(jump).groupBy(*g, "x").agg(F.min("m").alias("m")))
        if lab.select(*g, "x", F.col("m").alias("_old")).join(new, [*g, "x"]).filter("m <> _old").isEmpty():
            release(lab)
            return new
        release(lab)
        lab = new


def cyclic_nodes(links: DataFrame, ids: DataFrame, g: Sequence[str], rows: int | None = ROWS) -> DataFrame | None:
    """The nodes (g, n) of ids that lie on a cycle of links (g, n, a), or None if there are none.

    Where each node that trimming leaves has one parent left, all of these lie on cycles. Else strongly connected
    components are split off by colouring: a colour is the least node that reaches a node; those of a colour that reach
    its namesake form a component with it."""
    g = list(g)
    inner, left = _trim(links, ids.select(*g, F.col("n").alias("x")), "n", "a", g, rows)
    inner, left = _trim(inner, left, "a", "n", g, rows)
    if left.isEmpty():
        return None
    if inner.groupBy(*g, "n").count().filter("count > 1").isEmpty():
        return left.select(*g, F.col("x").alias("n"))
    found = inner.filter("n = a").select(*g, "n")
    while not left.isEmpty():
        lab = _min_labels(inner, left, g, rows).select(*g, "x", F.col("m").alias("colour"))
        of = lambda c: lab.select(*g, F.col("x").alias(c), F.col("colour").alias(f"_{c}"))
        own = materialize(_join(_join(inner, of("n"), [*g, "n"], ["a"], rows=rows), of("a"), [*g, "a"], ["n"], rows=rows).filter("_n = _a").select(*g, "n", "a"))
        down = _min_labels(own.select(*g, F.col("n").alias("a"), F.col("a").alias("n")), left, g, rows)
        part = materialize(down.join(lab, [*g, "x"]).filter("m = colour").select(*g, "x", "colour"))
        big = part.groupBy(*g, "colour").count().filter("count > 1").select(*g, "colour")
        found = found.unionByName(_join(part, big, [*g, "colour"], ["x"], "left_semi", rows=rows).select(*g, F.col("x").alias("n")))
        left = materialize(left.join(part, [*g, "x"], "left_anti"))
        inner = materialize(_join(_join(inner, left.withColumnRenamed("x", "n"), [*g, "n"], ["a"], "left_semi", rows=rows), left.withColumnRenamed("x", "a"), [*g, "a"], ["n"], "left_semi", rows=rows))
    return materialize(found.distinct())


def _least(df: DataFrame, key: list[str], paths: bool) -> DataFrame:
    """The shortest way (d, p) of each key; the least by its nodes of those as short."""
    if paths:
        return df.groupBy(*key).agg(F.min(F.struct("d", "p")).alias("_b")).select(*key, "_b.d", "_b.p")
    return df.groupBy(*key).agg(F.min("d").alias("d"), F.first("p").alias("p"))


def _beyond(above: DataFrame, every: DataFrame, cyc: DataFrame, g: list[str], paths: bool, rows: int) -> DataFrame:
    """(g, n, t, d, p): of each node on a cycle the roots that it is reached from. above: the links whose child lies on a
    cycle; every: what their other ends are resolved to. Lengths are lowered along links and along jumps of 2^k links
    until none falls; where no root is reached there is nothing to lower."""
    seg = F.array("n") if paths else F.col("p")
    got = salted_join(above, every.withColumnRenamed("n", "a"), [*g, "a"], ["n"], rows=rows).select(*g, "n", "t", (F.col("d") + 1).alias("d"), (F.concat("p", seg) if paths else seg).alias("p"))
    got = materialize(_least(got, [*g, "n", "t"], paths))
    mark = cyc.select(*g, F.col("n").alias("t"))
    best = materialize(salted_join(got, mark, [*g, "t"], ["n"], "left_anti", rows=rows))
    step = materialize(salted_join(got, mark, [*g, "t"], ["n"], "left_semi", rows=rows))
    if best.isEmpty() or step.isEmpty():
        return best
    add = lambda p, q: F.concat(p, q) if paths else F.col(p)
    key, front, rounds = [*g, "n", "t"], best, 0
    while not front.isEmpty():
        if rounds == 8:  # the cycles are long
            step = _jumps(step, cyc.count(), g, paths, rows)
        links = step.select(*g, F.col("n").alias("_x"), F.col("t").alias("n"), F.col("d").alias("_d"), F.col("p").alias("_p"))
        more = salted_join(links, front, [*g, "n"], ["_x"], rows=rows).select(*g, F.col("_x").alias("n"), "t", (F.col("d") + F.col("_d")).alias("d"), add("p", "_p").alias("p"))
        new = materialize(_least(best.unionByName(more), key, paths))
        old = best.select(*key, F.col("d").alias("_d"), F.col("p").alias("_p"))
        front = materialize(new.join(old, key, "left").filter("_d is null or d < _d or (d = _d and p <> _p)" if paths else "_d is null or d < _d").select(*new.columns))
        best, rounds = new, rounds + 1
    return best


def _jumps(step: DataFrame, n: int, g: list[str], paths: bool, rows: int) -> DataFrame:
    """The links step (g, n, t, d, p) among n nodes with jumps of 2^k links, along one link of each node."""
    add = lambda p, q: F.concat(p, q) if paths else F.col(p)
    jump = materialize(step.groupBy(*g, "n").agg(F.min(F.struct("d", "t", "p")).alias("_b")).select(*g, "n", "_b.t", "_b.d", "_b.p"))
    for _ in range(n.bit_length()):
        to = jump.select(*g, F.col("n").alias("t"), F.col("t").alias("_t"), F.col("d").alias("_d"), F.col("p").alias("_p"))
        jump = materialize(salted_join(jump, to, [*g, "t"], ["n"], rows=rows).select(*g, "n", F.col("_t").alias("t"), (F.col("d") + F.col("_d")).alias("d"), add("_p", "p").alias("p")))
        step = step.unionByName(jump)
    return materialize(_least(step, [*g, "n", "t"], paths))


def _local(e: DataFrame, ids: DataFrame, g: list[str], node: str) -> DataFrame:
    """hierarchy() of small scopes: nodes without links are rows without a parent."""
    rows = e.unionByName(ids.filter("root").select(*g, "n", F.lit(None).cast(ids.schema["n"].dataType).alias("a")))
    kind = rows.schema["n"].dataType
    names = [*g, node, "root", "depth"]
    schema = T.StructType([*[rows.schema[c] for c in g], T.StructField(node, kind), T.StructField("root", kind), T.StructField("depth", T.IntegerType())])
    return rows.repartition(*g).sortWithinPartitions(*g).mapInArrow(solver(len(g), names), schema)


def hierarchy(
    edges: DataFrame, scope: Sequence[str], child: str, parent: str, nodes: DataFrame | None = None, node: str = "node", paths: bool = False, every_ancestor: bool = False, through_cycles: bool = False, rows: int = ROWS, local: int = LOCAL
) -> DataFrame:
    """(scope, node, root, depth[, path]) of each node.

    A root has itself with depth 0. A node on a cycle has the one row (null, -1). Any other node has one row for each
    root it can be reached from, with the edges of the shortest way; if there is none, the one row (null, -2). path:
    the nodes from root to node on the shortest way, the least by its nodes, in order, of those as short.
    every_ancestor: a row for each ancestor in place of each root, which is the list of all descendants read the other
    way round; nodes on cycles have none but their own, unless through_cycles: then they have, besides that row as their
    mark, a row for each ancestor as all others do, and as their own ancestors two: with depth 0, and with the edges of
    the shortest way round. Links with a null end are no links, but their other end is a node; repeated links count
    once; rows with a null scope are ignored. No edges and nodes: no rows. `nodes` (scope, node) adds nodes without
    links. Scopes of up to `local` links are solved whole; of these, paths and every ancestor are found by joins, for they
    may be far more than the links.
    """
    g = list(scope)
    e0 = edges.select(*g, F.col(child).alias("n"), F.col(parent).alias("a")).dropna(subset=g).distinct()
    ends = e0.select(*g, "n").unionByName(e0.select(*g, F.col("a").alias("n")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(*g, F.col(node).alias("n")).dropna(subset=g))
    links = materialize(e0.dropna())
    ids = materialize(ends.dropna().join(links.select(*g, "n").distinct().withColumn("_has", F.lit(True)), [*g, "n"], "left").select(*g, "n", F.col("_has").isNull().alias("root")).distinct())
    plain = not (paths or every_ancestor)
    sizes = materialize(links.groupBy(*g).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > local))
    if sizes.isEmpty():
        small, large = _local(links, ids, g, node), None
    else:
        hot, names = hot_keys(sizes, g, rows, "_c"), sizes.select(*g)
        part = lambda df, on, how: salted_join(df, names, g, on, how, rows, hot)
        small = _local(part(links, ["n", "a"], "left_anti"), part(ids, ["n"], "left_anti"), g, node)
        large = materialize(part(links, ["n", "a"], "left_semi")), materialize(part(ids, ["n"], "left_semi"))
    cyc = cyclic_nodes(*large, g, rows if large[0].count() > rows else None) if large else None
    if plain:
        return small if large is None else small.unionByName(_spread(*large, cyc, g, node, False, False, False, rows))
    mine = materialize(small.filter(F.col("depth") == ON_CYCLE).select(*g, F.col(node).alias("n")))
    cyc = mine if cyc is None else mine.unionByName(cyc)
    return _spread(links, ids, None if cyc.isEmpty() else cyc, g, node, paths, every_ancestor, through_cycles, rows)


def _spread(links: DataFrame, ids: DataFrame, cyc: DataFrame | None, g: list[str], node: str, paths: bool, every: bool, through_cycles: bool, rows: int) -> DataFrame:
    """hierarchy() by joins. links: (g, n, a), distinct; ids: (g, n, root); cyc: the nodes on cycles."""
    kind = ids.schema["n"].dataType
    none = F.lit(None).cast(kind)
    ends = ids.filter("root").select(*g, "n")
    used = links
    if cyc is not None and not every:
        used = materialize(salted_join(links, cyc, [*g, "n"], ["a"], "left_anti", rows=rows))
        ends = ends.unionByName(cyc)
    ends = materialize(ends)
    no_path = F.expr("array()").cast(T.ArrayType(kind))
    seg = F.array("n") if paths else no_path
    first = salted_join(used, ends.select(*g, F.col("n").alias("a"), F.lit(True).alias("_r")), [*g, "a"], ["n"], "left", rows=rows)
    first = first.select(*g, "n", F.col("a").alias("t"), F.col("_r").isNotNull().alias("done"), F.lit(1).cast("long").alias("d"), seg.alias("p"))
    if every:
        first = first.unionByName(first.filter("not done").withColumn("done", F.lit(True)))
    state, last = materialize(first), None
    while True:
        n = {r.done: r["count"] for r in state.groupBy("done").count().collect()}
        # with every ancestor: no pair is longer than 2^k links if none is longer than 2^(k-1)
        if not n.get(False) or (every and last == n.get(True, 0)):
            break
        last = n.get(True, 0)
        act = state.filter("not done").select(*g, "n", F.col("t").alias("_via"), F.col("d").alias("_d"), F.col("p").alias("_p"))
        to = state.select(*g, F.col("n").alias("_via"), "t", "done", "d", "p")
        on = [*g, "_via"]
        joined = salted_join(act, to, on, ["n"], rows=rows) if n[False] > rows else act.join(to.hint("merge"), on)
        joined = joined.select(*g, "n", "t", "done", (F.col("d") + F.col("_d")).alias("d"), (F.concat("p", "_p") if paths else F.col("p")).alias("p"))
        was, state = state, materialize(_least(joined.unionByName(state.filter("done")), [*g, "n", "t", "done"], paths))
        release(was)
    done = state.filter("done").select(*g, "n", "t", "d", "p")
    own = (ids if every else ids.filter("root")).select(*g, "n", F.col("n").alias("t"), F.lit(0).cast("long").alias("d"), no_path.alias("p"))
    out = done.unionByName(own)
    if cyc is not None:
        mark = cyc.select(*g, "n", none.alias("t"), F.lit(ON_CYCLE).cast("long").alias("d"), F.lit(None).cast(T.ArrayType(kind)).alias("p"))
        if every:
            out = (out if through_cycles else out.join(cyc, [*g, "n"], "left_anti")).unionByName(mark)
        else:
            above = salted_join(links, cyc, [*g, "n"], ["a"], "left_semi", rows=rows)
            at = ends.select(*g, "n", F.col("n").alias("t"), F.lit(0).cast("long").alias("d"), no_path.alias("p"))
            roots = _beyond(above, done.unionByName(at), cyc, g, paths, rows).select(*g, F.col("n").alias("t"), F.col("t").alias("_t"), F.col("d").alias("_d"), F.col("p").alias("_p"))
            # what ends at a node on a cycle goes on to that node's roots
            at_cyc = cyc.select(*g, F.col("n").alias("t"))
            over = salted_join(salted_join(done, at_cyc, [*g, "t"], ["n"], "left_semi", rows=rows), roots, [*g, "t"], ["n"], rows=rows)
            over = over.select(*g, "n", F.col("_t").alias("t"), (F.col("d") + F.col("_d")).alias("d"), (F.concat("_p", "p") if paths else F.col("p")).alias("p"))
            plain = salted_join(done, at_cyc, [*g, "t"], ["n"], "left_anti", rows=rows)
            found = materialize(_least(plain.unionByName(over), [*g, "n", "t"], paths).unionByName(own))
            lost = ids.select(*g, "n").join(found.select(*g, "n").unionByName(cyc).distinct(), [*g, "n"], "left_anti")
            out = found.unionByName(mark).unionByName(lost.select(*g, "n", none.alias("t"), F.lit(NO_ROOT).cast("long").alias("d"), F.lit(None).cast(T.ArrayType(kind)).alias("p")))
    path = F.when(F.col("d") >= 0, F.concat_ws(SEP, F.concat(F.array("t"), "p").cast("array<string>"))).alias("path")
    return out.select(*g, F.col("n").alias(node), F.col("t").alias("root"), F.col("d").cast("int").alias("depth"), *([path] if paths else []))
