"""Parent links of unknown depth to roots, paths, depths, descendants and cycles.

A node has one parent at most, so a component of such links has either one root or one cycle.

1. Components: every node points at its parent, and pointers are doubled until they end at a root.
   A round that ends no pointer shows that the rest never ends: those lie on or under a cycle, and
   are named by the smallest node of their cycle: in one task if they are up to `big` nodes, else by
   doubling on with the smallest node met.
2. Components of up to `big` nodes are brought together and walked depth first by an iterative
   traversal with node colours (white, grey, black); a link to a grey node closes a cycle.
3. Larger components never meet in one task: their paths are doubled along with the pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.plans.runtime import broadcast_within, discard, publish, shuffle_width

#: Components of more nodes than this are handled without bringing them together.
BIG = 100_000
#: Bytes of the names of large components up to which they are broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes of paths that a traversal holds before it hands them on.
FLUSH = 4 << 20

WALKED = (
    "space string, node long, root long, path string, depth int, descendants long, marks int, on_cycle boolean, "
    "back_edge boolean"
)


def _links(nodes: DataFrame) -> DataFrame:
    """One row per (space, node) with `par`, its parent where that is in the same space and scope."""
    given = nodes.columns
    one = (
        nodes.where("node is not null and space is not null")
        .select(
            "space",
            F.col("node").cast("long").alias("node"),
            (F.coalesce(F.col("version").cast("long"), F.lit(-(1 << 62))) if "version" in given else F.lit(0).cast("long")).alias("v"),
            F.coalesce(F.col("parent").cast("long"), F.lit(0)).alias("parent"),
            (F.col("scope").cast("long") if "scope" in given else F.lit(0).cast("long")).alias("scope"),
            (F.expr("size(regexp_extract_all(coalesce(crumb, ''), '[0-9]+', 0))") if "crumb" in given else F.lit(0)).alias("marks"),
        )
        .groupBy("space", "node")
        .agg(F.max(F.struct("v", "parent", "scope", "marks")).alias("r"))
        .select("space", "node", "r.parent", "r.scope", "r.marks")
    )
    one = publish(one, "nodes")
    up = one.select(F.col("space").alias("s2"), F.col("node").alias("n2"), F.col("scope").alias("c2"))
    child = one.where("parent <> 0")
    met = child.join(
        up, (child["space"] == up["s2"]) & (child["parent"] == up["n2"]) & child["scope"].eqNullSafe(up["c2"]), "left"
    ).select("space", "node", "marks", F.col("n2").alias("par"))
    top = one.where("parent = 0").select("space", "node", "marks", F.lit(None).cast("long").alias("par"))
    links = publish(met.union(top), "parents")
    discard(one)
    return links


def _double(links: DataFrame, paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with a root (space, node, par, marks, root[, path]), and the rest, whose pointers never end.

    Every round looks pointers up among that round's pointers of all nodes, so their length doubles.
    """
    keep = ["space", "node", "par", "marks", "ptr", "done", *(["path"] if paths else [])]
    start = links.withColumn("ptr", F.coalesce("par", "node")).withColumn("done", F.col("par").isNull())
    if paths:
        start = start.withColumn("path", F.concat_ws("/", "par", "node"))  # concat_ws leaves out a null
    start = start.select(*keep)
    done, rest, table = [start.where("done")], start.where("not done"), start
    left = rest.count()
    while left:
        t = table.select(*[F.col(c).alias(f"{c}2") for c in keep if c not in ("par", "marks")])
        # a path begins with its pointer and the pointer's own path ends with it: leave one out
        longer = [F.expr("concat(path2, substring(path, length(cast(ptr as string)) + 1))").alias("path")] if paths else []
        step = publish(
            rest.join(t, (rest["space"] == t["space2"]) & (rest["ptr"] == t["node2"])).select(
                "space", "node", "par", "marks", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), *longer
            ),
            "pointers",
        )
        still = step.where("not done").count()
        if still == left:  # no chain is longer than this: the rest hangs on cycles
            discard(step)
            break
        left = still
        done.append(step.where("done"))
        rest = step.where("not done")
        table = rest
        for d in done:
            table = table.unionByName(d)
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.unionByName(d)
    return all_done.withColumnRenamed("ptr", "root").drop("done"), rest


def _rings(rest: DataFrame, big: int) -> DataFrame:
    """(space, node, par, marks, name, on_cycle): the name is the smallest node of the cycle above."""
    if rest.count() <= big:
        cols = "space string, node long, par long, marks int"
        return publish(rest.select("space", "node", "par", "marks").repartition(1).mapInArrow(_ring_walk, cols + ", name long, on_cycle boolean"), "rings")
    low = F.least("node", "par").alias("low")
    now = publish(rest.select("space", "node", "par", "marks", F.col("par").alias("ptr"), low), "ring")
    steps, n = 1, now.count()
    while steps < n:
        t = now.select(F.col("space").alias("s2"), F.col("node").alias("n2"), F.col("ptr").alias("p2"), F.col("low").alias("l2"))
        new = publish(
            now.join(t, (now["space"] == t["s2"]) & (now["ptr"] == t["n2"])).select(
                "space", "node", "par", "marks", F.col("p2").alias("ptr"), F.least("low", "l2").alias("low")
            ),
            "ring",
        )
        discard(now)
        now, steps = new, steps * 2
    # after as many steps as there are nodes, pointers lie on cycles, and every node of a cycle is one
    ring = now.select("space", F.col("ptr").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    t = now.select(F.col("space").alias("s2"), F.col("node").alias("n2"), F.col("low").alias("name"))
    return publish(
        now.join(t, (now["space"] == t["s2"]) & (now["ptr"] == t["n2"]))
        .select("space", "node", "par", "marks", "name")
        .join(ring, ["space", "node"], "left")
        .withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False))),
        "rings",
    )


def _ring_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_rings` gives, for few enough nodes to be in one task: go up from every node once."""
    t = pa.Table.from_batches(batches, schema=_REST)
    if not len(t):
        return
    keys = list(zip(t.column("space").to_pylist(), t.column("node").to_pylist()))
    up = {k: (k[0], p) for k, p in zip(keys, t.column("par").to_pylist())}
    name: dict[tuple, int] = {}
    ring: set[tuple] = set()
    for start in keys:
        trail, place, at = [], {}, start
        while at not in name and at not in place:
            place[at] = len(trail)
            trail.append(at)
            at = up[at]
        if at not in name:  # back on this trail: a new cycle
            cycle = trail[place[at] :]
            ring.update(cycle)
            name.update(dict.fromkeys(cycle, min(n for _, n in cycle)))
        for k in trail:
            name.setdefault(k, name[at])
    yield pa.RecordBatch.from_arrays(
        [*(c.combine_chunks() for c in t.columns), pa.array([name[k] for k in keys]), pa.array([k in ring for k in keys])],
        names=[*t.column_names, "name", "on_cycle"],
    )


_REST = pa.schema([("space", pa.string()), ("node", pa.int64()), ("par", pa.int64()), ("marks", pa.int32())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-first traversal of each component; rows come in order of (space, name)."""
    schema = pa.schema(
        [("space", pa.string()), ("node", pa.int64()), ("root", pa.int64()), ("path", pa.string()), ("depth", pa.int32()),
         ("descendants", pa.int64()), ("marks", pa.int32()), ("on_cycle", pa.bool_()), ("back_edge", pa.bool_())]
    )
    out: list[list] = [[] for _ in schema]
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        out, held = [[] for _ in schema], 0
        return b

    def component(space: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal held
        parent = {n: p for n, p, _ in rows}
        marks = {n: m for n, _, m in rows}
        kids: dict[int, list[int]] = {}
        for n in sorted(parent):
            if parent[n] is not None:
                kids.setdefault(parent[n], []).append(n)
        root = next((n for n, p in parent.items() if p is None), None)
        ring: set[int] = set()
        start = root
        if root is None:  # go up, colouring grey, until a grey node closes the cycle
            seen: dict[int, int] = {}
            at = min(parent)
            while at not in seen:
                seen[at] = len(seen)
                at = parent[at]
            ring = {n for n, k in seen.items() if k >= seen[at]}
            start = min(ring)
        grey, black = 1, 2
        colour, below, back = {start: grey}, dict.fromkeys(parent, 0), set()
        order, stack = [(start, 1)], [(start, iter(kids.get(start, ())))]
        while stack:
            n, more = stack[-1]
            kid = next(more, None)
            if kid is None:
                stack.pop()
                colour[n] = black
                if stack:
                    below[stack[-1][0]] += below[n] + 1
            elif colour.get(kid) == grey:
                back.add(kid)  # kid's link up to n leads back under kid
            else:
                colour[kid] = grey
                stack.append((kid, iter(kids.get(kid, ()))))
                order.append((kid, len(stack)))
        trail: list[str] = []
        for n, depth in order:
            if root is not None:
                del trail[depth - 1 :]
                trail.append(str(n))
                row = (space, n, root, "/".join(trail), depth, below[n], marks[n], False, False)
            else:
                row = (space, n, 0, "", 0, 0, marks[n], n in ring, n in back)
            for c, v in zip(out, row):
                c.append(v)
            held += len(row[3]) + 60
            if held > FLUSH:
                yield flush()

    key, rows = None, []
    for b in batches:
        for space, name, node, par, mark in zip(*(b.column(c).to_pylist() for c in ("space", "name", "node", "par", "marks"))):
            if key != (space, name):
                if rows:
                    yield from component(key[0], rows)
                key, rows = (space, name), []
            rows.append((node, par, mark))
    if rows:
        yield from component(key[0], rows)
    if out[0]:
        yield flush()


def hierarchy(nodes: DataFrame, big: int = BIG, below: bool = True) -> DataFrame:
    """Every node's root, path, depth and number of descendants; the nodes that have no root.

    `nodes`: `space` (a table's name, say), `node`, `parent`, and optionally `scope` (a link across
    scopes doesn't hold), `crumb` (text whose numbers are counted) and `version` (of rows that repeat
    a node the one with the highest counts). Other columns are ignored. A node is a root if its
    parent is null, 0, absent or of another scope; null scopes are alike. Rows with a null node are
    left out; a node that is its own parent is a cycle of one.

    Columns: space, node, root (0 on or under a cycle), path ('' there), depth (0 there; a root has
    1), descendants (0 there; null in components over `big` nodes unless `below`, as counting them
    goes over all paths once more), marks (numbers in the crumb), on_cycle, back_edge (true for the
    smallest node of a cycle, whose link up closes it).
    """
    spark = nodes.sparkSession
    links = _links(nodes)
    done, rest = _double(links)
    cols = ["space", "node", "par", "marks", "name", "on_cycle"]
    comp = done.withColumnRenamed("root", "name").withColumn("on_cycle", F.lit(False)).select(*cols)
    if not rest.isEmpty():
        comp = comp.unionByName(_rings(rest, big).select(*cols))
    comp = publish(comp, "components")
    n = comp.count()
    huge, n_huge = None, 0
    if n > big:
        huge = publish(comp.groupBy("space", "name").count().where(F.col("count") > big).select("space", "name"), "huge")
        n_huge = huge.count()
    small = comp if not n_huge else comp.join(broadcast_within(huge, BROADCAST_BYTES), ["space", "name"], "left_anti")
    width = max(shuffle_width(spark), -(-n // 500_000))
    walked = (
        small.select("space", "name", "node", "par", "marks")
        .repartition(width, "space", "name")
        .sortWithinPartitions("space", "name")
        .mapInArrow(_walk, WALKED)
    )
    if not n_huge:
        return walked
    large = comp.join(broadcast_within(huge, BROADCAST_BYTES), ["space", "name"], "left_semi")
    ringed = large.join(rest.select("space", "node"), ["space", "node"], "left_semi").select(
        "space", "node", F.lit(0).cast("long").alias("root"), F.lit("").alias("path"), F.lit(0).alias("depth"),
        F.lit(0).cast("long").alias("descendants"), "marks", "on_cycle", (F.col("node") == F.col("name")).alias("back_edge"),
    )
    rooted, _ = _double(large.select("space", "node", "par", "marks").join(rest.select("space", "node"), ["space", "node"], "left_anti"), paths=True)
    rooted = publish(rooted, "paths")
    counts = (
        rooted.select("space", F.explode(F.split("path", "/")).alias("node"))
        .groupBy("space", F.col("node").cast("long").alias("node"))
        .agg((F.count("*") - 1).alias("descendants"))
    )
    rooted = rooted.join(counts, ["space", "node"]) if below else rooted.withColumn("descendants", F.lit(None).cast("long"))
    rooted = rooted.select(
        "space", "node", "root", "path", F.size(F.split("path", "/")).alias("depth"), "descendants", "marks",
        F.lit(False).alias("on_cycle"), F.lit(False).alias("back_edge"),
    )
    return walked.unionByName(rooted).unionByName(ringed)


def descendants(tree: DataFrame) -> DataFrame:
    """(space, node, descendant, distance) for every node above another, from `hierarchy`'s paths."""
    up = F.posexplode(F.split("path", "/"))
    return (
        tree.where("path <> ''")
        .select("space", F.col("node").alias("descendant"), "depth", up)
        .where("pos < depth - 1")
        .select("space", F.col("col").cast("long").alias("node"), "descendant", (F.col("depth") - 1 - F.col("pos")).alias("distance"))
    )
