"""Parent-child links to full hierarchies.

Weighted disjoint-set forests: a link ``vertex -> parent`` joins two sets and carries an offset, the
number of steps from a vertex to the top of its set. Links are first combined inside blocks (a task
sees a block as numpy arrays and finds all tops at once by path compression, offsets adding up).
Groups (runs) that fit one block are finished there. In a larger group the top of a vertex may be a
vertex of another block; all children that a block holds of one such vertex share it as their top,
so a hub is one row per block. Those tops are merged hierarchically: each round joins every open top
to the link of its own top, so spans double, offsets add up, and roots and cycles appear after
log2(size) rounds.

The same weighted find gives everything else: depth (weight 1), place in preorder (weight: one plus
the sizes of the smaller siblings' trees) and, by doubling the other way, tree sizes. Results stay
linear in the number of vertices: a path is kept in pages of ``PAGE`` vertices, each page naming the
vertex whose path precedes it, and descendants are an interval of preorder numbers. ``full_paths``
and ``descendant_pairs`` expand both, in as much space as the answer has.

Status codes of a vertex: 0 resolved to a root, 1 ends in a cycle, 2 ends nowhere (null or negative
parent, or a parent without a row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import Scratch, broadcast_if_small

ROOTED, CYCLIC, DANGLING, OPEN = 0, 1, 2, 3

#: Rows that one block may hold: some twenty arrays of 8 bytes each, about 100 MB of Python memory.
BLOCK_ROWS = 500_000
#: Vertices in a page of a path.
PAGE = 64


def latest_links(df: DataFrame, group: str, node: str, parent: str, version: str | None) -> DataFrame:
    """One link per (group, node): that of the latest version.

    Repeated rows collapse before the shuffle (the maximum is combined map-side). A null version
    loses against any other; rows that tie keep the larger parent, so the choice is deterministic.
    Rows with a null group or node name no vertex and are skipped.
    """
    ver = F.col(version) if version else F.lit(0)
    return (
        df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
        .select(F.col(group).cast("long").alias("g"), F.col(node).cast("long").alias("v"), F.struct(ver.alias("t"), F.col(parent).cast("long").alias("p")).alias("s"))
        .groupBy("g", "v")
        .agg(F.max("s").alias("s"))
        .select("g", "v", F.col("s.p").alias("p"))
    )


def _find(par: np.ndarray, stop: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top, summed weight up to it and cyclic flag of every index of a local forest.

    ``par`` holds local parent indices, ``stop`` marks tops. After r passes a pointer spans 2^r steps;
    an index whose pointer is no top after more than n steps runs in a cycle.
    """
    n = len(par)
    ptr = np.where(stop, np.arange(n), par)
    off = np.where(stop, 0, weight).astype(np.int64)
    span = 1
    while span <= n and not stop[ptr].all():
        off += off[ptr]
        ptr = ptr[ptr]
        span *= 2
    return ptr, off, ~stop[ptr]


def _ring_low(par: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Smallest value on the cycle of each index of ``at`` (indices that lie on cycles)."""
    low, ptr, span = values.copy(), par.copy(), 1
    while span <= len(par):  # the span must cover the longest cycle
        low = np.minimum(low, low[ptr])
        ptr = ptr[ptr]
        span *= 2
    return low[at]


def _tree_sizes(par: np.ndarray, inner: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Vertices of every vertex's tree; ``inner`` marks rooted vertices that are no root."""
    n = len(par)
    size = np.ones(n, np.int64)
    ptr = np.where(inner, par, np.arange(n))
    span = 1
    left = np.where(inner, depth, 0)  # steps up to the root
    while True:
        move = np.flatnonzero(left >= span)
        if not len(move):
            return size
        size = size + np.bincount(ptr[move], weights=size[move], minlength=n).astype(np.int64)
        ptr = ptr[ptr]
        span *= 2


def _sibling_step(par: np.ndarray, inner: np.ndarray, size: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One plus the summed tree sizes of the smaller siblings."""
    step = np.zeros(len(par), np.int64)
    at = np.flatnonzero(inner)
    if not len(at):
        return step
    at = at[np.lexsort((v[at], par[at]))]
    run = np.cumsum(size[at]) - size[at]
    first = np.append(True, par[at][1:] != par[at][:-1])
    step[at] = 1 + run - np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(at))))
    return step


def _pages(par: np.ndarray, rooted: np.ndarray, depth: np.ndarray, v: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The page of every rooted vertex and the vertex before it (null on a first page)."""
    n = len(par)
    length = np.where(rooted, depth % PAGE + 1, 0)
    end = np.cumsum(length)
    flat = np.zeros(int(end[-1]) if n else 0, np.int64)
    at = np.flatnonzero(rooted)
    cur = at.copy()
    before = np.full(n, -1)
    for k in range(PAGE):
        if not len(at):
            break
        flat[end[at] - 1 - k] = v[cur]
        last = depth[at] % PAGE == k
        done = at[last & (depth[at] > k)]
        before[done] = par[cur[last & (depth[at] > k)]]
        at, cur = at[~last], par[cur[~last]]
    offsets = pa.array(np.append(0, end), pa.int32(), mask=np.append(~rooted, False))
    pages = pa.ListArray.from_arrays(offsets, pa.array(flat)) if n else pa.array([], pa.list_(pa.int64()))
    return pages, pa.array(np.where(before >= 0, v[before], 0), mask=before < 0)


_FIELDS = [("g", pa.int64()), ("b", pa.int32()), ("v", pa.int64()), ("p", pa.int64()), ("top", pa.int64()), ("off", pa.int64()), ("status", pa.int32()), ("wide", pa.bool_())]
_DETAIL = [("pre", pa.int64()), ("last", pa.int64()), ("before", pa.int64()), ("page", pa.list_(pa.int64()))]
_DDL = "g long, b int, v long, p long, top long, off long, status int, wide boolean"
_DETAIL_DDL = ", pre long, last long, before long, page array<long>"


def _solve(table: pa.Table, detail: bool) -> pa.Table:
    """Resolve all links inside one table (columns g, b, v, p, wide).

    Links of a narrow group (all of its rows are here) end as ROOTED, CYCLIC or DANGLING. In a wide
    group a vertex whose chain leaves the block is OPEN, its top the first vertex outside.
    """
    g, b, v = (table.column(c).to_numpy() for c in ("g", "b", "v"))
    p_null = np.asarray(table.column("p").is_null())
    p = np.asarray(table.column("p").fill_null(-1).to_numpy()).copy()
    wide = table.column("wide").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((v, b, g))
    g, b, v, p, p_null, wide = g[order], b[order], v[order], p[order], p_null[order], wide[order]
    n = len(v)
    # index parents: vectorised binary search inside each vertex's own (group, block)
    new = np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1]))
    rank = np.cumsum(new) - 1
    lo, hi = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], n)
    left, right = lo[rank].copy(), hi[rank].copy()
    while (open_ := left < right).any():
        mid = (left + right) // 2
        less = open_ & (v[np.minimum(mid, n - 1)] < p)
        left = np.where(less, mid + 1, left)
        right = np.where(open_ & ~less, mid, right)
    at = np.minimum(left, n - 1)
    # a negative parent may be a vertex by number; it is a missing parent by definition
    here = (left < hi[rank]) & (v[at] == p) & ~p_null & (p >= 0)
    root = here & (at == np.arange(n))
    leaves = ~here & wide & ~p_null & (p >= 0)
    stop = root | ~here
    par = np.where(here, at, np.arange(n))
    ptr, off, cyclic = _find(par, stop, np.ones(n, np.int64))
    status = np.full(n, DANGLING, np.int32)
    status[root[ptr] & ~cyclic] = ROOTED
    away = leaves[ptr] & ~cyclic
    status[away] = OPEN
    top = v[ptr].copy()
    top[away] = p[ptr[away]]
    off[away] += 1
    if cyclic.any():
        status[cyclic] = CYCLIC
        top[cyclic] = _ring_low(par, v, ptr[cyclic])
        off[cyclic] = -1
    cols = [pa.array(g), pa.array(b.astype(np.int32)), pa.array(v), pa.array(p, mask=p_null), pa.array(top), pa.array(off), pa.array(status), pa.array(wide)]
    if detail:
        rooted = status == ROOTED
        inner = rooted & ~root
        rooted = rooted & ~wide
        depth = np.where(status == ROOTED, off, 0)
        size = _tree_sizes(par, inner, depth)
        _, pre, _ = _find(np.where(inner, par, np.arange(n)), ~inner, _sibling_step(par, inner, size, v))
        page, before = _pages(par, rooted, depth, v)
        cols += [pa.array(pre, mask=~rooted), pa.array(pre + size - 1, mask=~rooted), before, page]
    return pa.table(cols, schema=pa.schema(_FIELDS + (_DETAIL if detail else [])))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole (g, b) blocks of sorted batches, of ``rows`` rows or one block if that is larger."""
    held: list[pa.RecordBatch] = []
    n = 0
    for x in batches:
        if not x.num_rows:
            continue
        if n + x.num_rows > rows and n:
            # close the table at the last border of blocks seen
            t = pa.Table.from_batches([*held, x])
            g, b = t.column("g").to_numpy(), t.column("b").to_numpy()
            border = np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1])) + 1
            if len(border):
                cut = int(border[-1])
                yield t.slice(0, cut).combine_chunks()
                t = t.slice(cut)
            held, n = t.combine_chunks().to_batches(), t.num_rows
        else:
            held.append(x)
            n += x.num_rows
    if held:
        yield pa.Table.from_batches(held)


def resolve_hierarchy(df: DataFrame, group: str, node: str, parent: str, version: str | None = None, detail: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Root, depth and status of every vertex of every group.

    Returns ``g, v, p, root, depth, status``: for ROOTED vertices the root and the number of steps to
    it; for CYCLIC ones the smallest vertex on the cycle and depth -1; for DANGLING ones null and
    null. A vertex that is its own parent is a root even if several exist. With ``detail`` ROOTED
    vertices also carry

    * ``pre, last``: their place in the preorder of their tree (smaller siblings first, roots 0) and
      the last place of their descendants, which are exactly the vertices of that tree with
      pre < place <= last;
    * ``page, before``: the end of the path root..vertex, at most ``PAGE`` vertices, and the vertex
      whose own path precedes the page (null if the page begins at the root).

    Empty input gives an empty result; extra columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hierarchy")
    links = scratch.write(latest_links(df, group, node, parent, version))
    total = links.count()
    rows, largest = links.withColumn("wide", F.lit(False)).withColumn("b", F.lit(0)), 0
    if total > block_rows:
        sizes = scratch.write(links.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("g", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("nb")))
        largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if largest:
            rows = links.join(broadcast_if_small(sizes), "g", "left").select("g", "v", "p", F.col("nb").isNotNull().alias("wide"), F.when(F.col("nb").isNotNull(), F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")).otherwise(F.lit(0)).alias("b"))
    # as many tasks as the session asks for, fewer for a small input, more if a task would exceed a block
    parts = max(1, -(-total // block_rows), min(total // 5_000 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        for t in _chunks(batches, block_rows):
            yield from _solve(t, detail).to_batches(max_chunksize=20_000)

    local = rows.repartition(parts, "g", "b").sortWithinPartitions("g", "b").select("g", "b", "v", "p", "wide").mapInArrow(run, _DDL + (_DETAIL_DDL if detail else ""))
    if largest:
        local = scratch.write(local)
        local = _merge_wide(local, largest, detail, scratch)
    return local.select(
        "g", "v", "p",
        F.when(F.col("status") != DANGLING, F.col("top")).alias("root"),
        F.when(F.col("status") == ROOTED, F.col("off")).when(F.col("status") == CYCLIC, F.lit(-1)).cast("long").alias("depth"),
        "status", *(["pre", "last", "before", "page"] if detail else []),
    )


def _double(links: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """Weighted find over a table of links ``g, top, ptr, o, st``.

    An OPEN row points to another row by ``ptr``, ``o`` away; rows of another status have ended at
    ``ptr``. Spans double each round; what is still open after a span beyond the largest group runs
    in a cycle and points to a vertex on it. Every ``top`` occurs once, and a ``ptr`` that many rows
    share is met by one row, so a skewed side can be split (adaptive skew join).
    """
    tl = scratch.write(links)
    for _ in range(int(np.ceil(np.log2(max(2, largest)))) + 1):
        if not tl.where(F.col("st") == OPEN).limit(1).count():
            break
        nxt = tl.select("g", F.col("top").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("o").alias("o2"), F.col("st").alias("st2"))
        move = tl.where(F.col("st") == OPEN).join(nxt, ["g", "ptr"], "left").select("g", "top", F.coalesce("ptr2", "ptr").alias("ptr"), (F.col("o") + F.coalesce("o2", F.lit(0))).alias("o"), F.coalesce("st2", F.lit(DANGLING)).alias("st"))
        new = scratch.write(tl.where(F.col("st") != OPEN).unionByName(move))
        scratch.drop(tl)
        tl = new
    return tl


def _merge_wide(local: DataFrame, largest: int, detail: bool, scratch: Scratch) -> DataFrame:
    """Merge the block forests of wide groups.

    Tops of other blocks are vertices, so each has a row of its own whose top and offset continue the
    chain. A hub is asked for by one row per block, and answers return to the rows block by block.
    """
    done = local.where(~F.col("wide"))
    cur = local.where("wide").select("g", "b", "v", "p", "top", "off", "status")
    asked = scratch.write(cur.where(F.col("status") == OPEN).select("g", "b", "top").distinct())
    own = cur.select("g", F.col("v").alias("top"), F.col("top").alias("ptr"), F.col("off").alias("o"), F.col("status").alias("st"))
    links = asked.select("g", "top").distinct().join(own, ["g", "top"], "left").select("g", "top", F.coalesce("ptr", "top").alias("ptr"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("st", F.lit(DANGLING)).alias("st"))
    tl = _double(links, largest, scratch)
    ring = tl.where(F.col("st") == OPEN)
    if ring.limit(1).count():
        tl = scratch.write(tl.where(F.col("st") != OPEN).unionByName(_ring_minimum(ring, cur.select("g", "v", "p"), largest, scratch)))
    ends = asked.join(tl.select("g", "top", F.col("ptr").alias("end"), F.col("o").alias("more"), F.col("st").alias("end_st")), ["g", "top"])
    is_open = F.col("status") == OPEN
    merged = scratch.write(cur.join(ends, ["g", "b", "top"], "left").select(
        "g", "b", "v", "p",
        F.when(is_open, F.col("end")).otherwise(F.col("top")).alias("top"),
        F.when(~is_open, F.col("off")).when(F.col("end_st") == CYCLIC, F.lit(-1)).otherwise(F.col("off") + F.col("more")).alias("off"),
        F.when(is_open, F.col("end_st")).otherwise(F.col("status")).cast("int").alias("status"),
        F.lit(True).alias("wide"),
    ))
    return done.unionByName(_wide_detail(merged, largest, scratch) if detail else merged)


def _ring_minimum(ring: DataFrame, links: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """Tops that run into a cycle, with the smallest vertex on that cycle as their end.

    Each top's pointer has walked past the tail, so the set of pointers lies on cycles. From those,
    the vertices on the cycle are walked by doubling once more, over plain vertices, until the span
    exceeds the largest group: only some vertices of a cycle are starts, so a round that changes no
    minimum proves nothing.
    """
    links = links.join(broadcast_if_small(ring.select("g").distinct()), "g", "left_semi")
    on = ring.select("g", F.col("ptr").alias("v")).distinct()
    reach = scratch.write(links.join(on, ["g", "v"], "left_semi").select("g", F.col("v").alias("start"), F.col("p").alias("ptr"), F.least("v", "p").alias("low")))
    step = scratch.write(links.select("g", F.col("v").alias("ptr"), F.col("p").alias("ptr2"), F.least("v", "p").alias("low2")))
    span = 1
    while span < largest:
        new = scratch.write(reach.join(step, ["g", "ptr"]).select("g", "start", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")))
        grown = scratch.write(step.join(step.select("g", F.col("ptr").alias("ptr2"), F.col("ptr2").alias("ptr3"), F.col("low2").alias("low3")), ["g", "ptr2"]).select("g", "ptr", F.col("ptr3").alias("ptr2"), F.least("low2", "low3").alias("low2")))
        scratch.drop(reach)
        scratch.drop(step)
        reach, step = new, grown
        span *= 2
    lows = reach.select("g", F.col("start").alias("ptr"), F.col("low").alias("ring_low"))
    return ring.join(lows, ["g", "ptr"], "left").select("g", "top", F.col("ring_low").alias("ptr"), F.lit(-1).cast("long").alias("o"), F.lit(CYCLIC).alias("st"))


def _wide_detail(merged: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """Preorder intervals and path pages of wide groups, by doubling over all their rooted vertices."""
    tree = merged.where(F.col("status") == ROOTED).select("g", "v", F.when(F.col("p") != F.col("v"), F.col("p")).alias("p"), F.col("off").alias("depth"))
    deepest = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    # Tree sizes: vertices within 2^k steps below, those 2^k further added each round.
    cur = scratch.write(tree.select("g", "v", F.col("p").alias("ptr"), F.lit(1).cast("long").alias("size")))
    span = 1
    while span <= deepest:
        below = cur.where("ptr is not null").groupBy("g", F.col("ptr").alias("v")).agg(F.sum("size").alias("more"))
        up = cur.select("g", F.col("v").alias("ptr"), F.col("ptr").alias("ptr2"))
        new = scratch.write(cur.join(below, ["g", "v"], "left").join(up, ["g", "ptr"], "left").select("g", "v", F.col("ptr2").alias("ptr"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        scratch.drop(cur)
        cur, span = new, span * 2
    sized = scratch.write(tree.join(cur.select("g", "v", "size"), ["g", "v"]))
    steps = _running_siblings(sized.where("p is not null"), scratch)
    pre = _double(
        steps.select("g", F.col("v").alias("top"), F.col("p").alias("ptr"), F.col("step").alias("o"), F.lit(OPEN).alias("st"))
        .unionByName(sized.where("p is null").select("g", F.col("v").alias("top"), F.col("v").alias("ptr"), F.lit(0).cast("long").alias("o"), F.lit(ROOTED).alias("st"))),
        largest, scratch,
    ).select("g", F.col("top").alias("v"), F.col("o").alias("pre"))
    # Pages: the PAGE nearest vertices upwards, twice as many each round, then cut at the page border.
    walk = scratch.write(sized.select("g", "v", F.col("p").alias("ptr"), F.array("v").alias("up")))
    for _ in range(PAGE.bit_length() - 1):
        nxt = walk.select("g", F.col("v").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("up").alias("up2"))
        new = scratch.write(walk.join(nxt, ["g", "ptr"], "left").select("g", "v", F.col("ptr2").alias("ptr"), F.concat("up", F.coalesce("up2", F.array().cast("array<long>"))).alias("up")))
        scratch.drop(walk)
        walk = new
    k = (F.col("depth") % PAGE + 1).cast("int")
    over = F.col("ptr")  # the vertex PAGE steps up, which is the one before a full page
    paged = walk.join(sized.select("g", "v", "depth", "size"), ["g", "v"]).select(
        "g", "v", "size", F.reverse(F.slice("up", F.lit(1), k)).alias("page"),
        F.when(F.col("depth") >= PAGE, F.coalesce(F.get("up", k), over)).alias("before"),
    )
    extra = paged.join(pre, ["g", "v"]).select("g", "v", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "before", "page")
    return merged.join(extra, ["g", "v"], "left").select(*merged.columns, "pre", "last", "before", "page")


def _running_siblings(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``g, v, p, step``: one plus the sizes of the smaller siblings' trees.

    Rows are range-partitioned by (g, p, v), so that even a hub's children are cut into even pieces;
    a piece's sums per parent carry over to the pieces behind it.
    """
    part = scratch.write(rows.select("g", "p", "v", "size").repartitionByRange("g", "p", "v").withColumn("k", F.spark_partition_id()))
    piece = part.groupBy("g", "p", "k").agg(F.sum("size").alias("s"))
    carry = piece.select("g", "p", "k", (F.sum("s").over(Window.partitionBy("g", "p").orderBy("k")) - F.col("s")).alias("carry"))
    inner = F.sum("size").over(Window.partitionBy("k", "g", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return part.withColumn("here", inner).join(carry, ["g", "p", "k"]).select("g", "v", "p", (1 + F.col("here") + F.col("carry")).alias("step"))


def full_paths(index: DataFrame) -> DataFrame:
    """``g, v, root, depth, path`` (root..vertex) of a result with ``detail``: exact and whole.

    Page ends (one vertex in ``PAGE`` at most) get their whole path by doubling; every other vertex
    adds its page to one of them. The result is as large as the paths are.
    """
    scratch = Scratch(index.sparkSession, "paths")
    rows = scratch.write(index.where(F.col("status") == ROOTED).select("g", "v", "root", "depth", "before", "page"))
    heads = scratch.write(rows.where(F.col("depth") % PAGE == PAGE - 1).select("g", "v", F.col("before").alias("ptr"), "page"))
    while heads.where("ptr is not null").limit(1).count():
        nxt = heads.select("g", F.col("v").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("page").alias("page2"))
        new = scratch.write(heads.join(nxt, ["g", "ptr"], "left").select("g", "v", F.col("ptr2").alias("ptr"), F.concat(F.coalesce("page2", F.array().cast("array<long>")), "page").alias("page")))
        scratch.drop(heads)
        heads = new
    start = heads.select("g", F.col("v").alias("before"), F.col("page").alias("start"))
    return rows.join(start, ["g", "before"], "left").select("g", "v", "root", "depth", F.concat(F.coalesce("start", F.array().cast("array<long>")), "page").alias("path"))


def descendant_pairs(index: DataFrame) -> DataFrame:
    """``g, ancestor, descendant, distance`` of every pair; as many rows as all depths sum to."""
    pairs = full_paths(index).select("g", F.col("v").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.where(F.col("at") < F.col("depth")).select("g", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
