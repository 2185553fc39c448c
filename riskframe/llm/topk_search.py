"""Exact top-k inner products by KD-trees, one tree a shard.

1. Median splits of a bounded sample cut the space into cells; vectors are dealt to shards by cell (a cell with many vectors is several shards by
   hash), so that shards lie together in space. A shard's tree splits at the median of its widest component until a leaf holds `leaf` vectors;
   each node keeps the tight box of its vectors. Trees are built once and written, their nodes as columns of packed numbers.
2. The product of a query with any vector of a box is at most sum(max(q * low, q * high)). A query visits cells by their boxes, best bound
   first, in rounds of 1, 3, 12, ... cells; the kth score of the rounds before goes along, and a cell whose bound lies under it is left out.
   Only trees of visited cells move, each once for every `block` queries that visit it.
3. Inside a shard a query visits leaves best bound first, in waves of 1, 3, 9, ... leaves together with the other queries of its block; its kth score rises
   on the way, and what lies under it is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SALTS, first_by_hash, saved

#: Below any score.
LOWEST = -(2**63 - 1)
#: Sampled vectors that the cells are cut from, and levels of cuts at most (beyond, a cell is more shards, none larger): both bound what the driver holds.
SAMPLE, MOST_LEVELS = 16_384, 14
#: Queries that are routed at once.
ROUTE = 512


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: array of floor(scale * x), whole numbers as doubles. One row an id (the least vector, should an id stand with several)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    v = v.where("id is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))")
    # beyond 2**53 every double is whole
    v = v.select("id", F.expr(f"transform(x, e -> if(abs({scale}D * e) < 9007199254740992D, double(floor({scale}D * e)), {scale}D * e))").alias("v"))
    return v.groupBy("id").agg(F.min("v").alias("v"))


def _rows(column):
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cuts(x, depth: int):
    """Median splits of a sample, level by level: axis and cut of node 1, 2, 3, ... (children of n: 2n and 2n + 1)."""
    import numpy as np

    axis, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    rows = {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        mine = rows.pop(node)
        if len(mine):
            axis[node] = int((x[mine].max(0) - x[mine].min(0)).argmax())
            cut[node] = np.median(x[mine, axis[node]])
        right = x[mine, axis[node]] > cut[node]
        rows[2 * node], rows[2 * node + 1] = mine[~right], mine[right]
    return axis, cut


def _cell(x, axis, cut, depth: int):
    import numpy as np

    node = np.ones(len(x), np.int64)
    for _ in range(depth):
        node = 2 * node + (x[np.arange(len(x)), axis[node]] > cut[node])
    return node


def _tree(ids, x, leaf: int) -> dict:
    """Nodes of a KD-tree as arrays: low and high corner, children (-1: leaf), first and last row; ids and vectors in leaf order."""
    import numpy as np

    low, high, left, right, first, last, order = [], [], [], [], [], [], []

    def grow(rows):
        k = len(low)
        low.append(x[rows].min(0))
        high.append(x[rows].max(0))
        left.append(-1)
        right.append(-1)
        first.append(0)
        last.append(0)
        wide = high[k] - low[k]
        axis = int(wide.argmax())
        if len(rows) > leaf and wide[axis] > 0:
            by = np.argsort(x[rows, axis], kind="stable")
            half = len(rows) // 2
            left[k] = grow(rows[by[:half]])
            right[k] = grow(rows[by[half:]])
        else:  # many equal vectors make a leaf that is as long as they are many
            first[k] = len(order)
            order.extend(rows[np.argsort(ids[rows])].tolist())
            last[k] = len(order)
        return k

    grow(np.arange(len(ids)))
    small = np.abs(x).max() < 2**31
    return {
        "low": np.array(low), "high": np.array(high), "left": np.array(left), "right": np.array(right), "first": np.array(first), "last": np.array(last),
        "ids": ids[order], "x": x[order].astype(np.int32 if small else np.float64),
    }


def _products(q, x, skip):
    """Exact products of whole numbers as int64. Where a sum may pass what doubles hold exactly, it is taken in Python's integers. Pairs of `skip` may hold anything."""
    import numpy as np

    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = np.abs(q).max(1)[:, None] * np.abs(x).max(1)[None] * q.shape[1]
    safe = most < 2.0**53
    if safe.all():
        return np.rint(q @ x.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.where(safe, q @ x.T, 0).astype(np.int64)
    for a, b in np.argwhere(~safe & ~skip).tolist():
        s = sum(int(m) * int(n) for m, n in zip(q[a].tolist(), x[b].tolist(), strict=True))
        if not LOWEST < s < 2**63:
            raise OverflowError(f"a score of {s} doesn't fit a long")
        found[a, b] = s
    return found


def _reach(q, low, high):
    """Largest product that each query can have with a vector of each box, with room for rounding where numbers are large."""
    import numpy as np

    reach = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    far = np.maximum(np.abs(low), np.abs(high))
    if np.abs(q).max() * far.max() * q.shape[1] >= 2.0**53:
        reach = reach + 2.0**-40 * (np.abs(q) @ far.T)
    return reach


def _search(tree: dict, qids, q, k: int, bound):
    """Scores and ids of the k best of each query among the shard's vectors that reach its bound."""
    import numpy as np

    low, high, left, right, first, last, ids = (tree[c] for c in ("low", "high", "left", "right", "first", "last", "ids"))
    score = np.full((len(qids), k), LOWEST, np.int64)
    best = np.full((len(qids), k), np.iinfo(np.int64).max, np.int64)
    kth = bound.copy()
    leaves = []
    front = [(0, np.arange(len(qids)))]
    while front:  # a query enters a child only where the child's box can reach the bound that came along
        deeper = []
        for node, who in front:
            if left[node] < 0:
                leaves.append((who, np.full(len(who), node), _reach(q[who], low[[node]], high[[node]])[:, 0]))
                continue
            pair = [left[node], right[node]]
            reach = _reach(q[who], low[pair], high[pair])
            deeper += [(child, who[ok]) for c, child in enumerate(pair) if (ok := reach[:, c] >= kth[who]).any()]
        front = deeper
    who, node, reach = (np.concatenate(p) for p in zip(*leaves, strict=True)) if leaves else ([], [], [])
    if not len(who):
        return score, best
    by = np.lexsort((-reach, who))  # each query's leaves, best bound first
    who, node, reach = who[by], node[by], reach[by]
    turn = np.arange(len(who)) - np.searchsorted(who, who)
    lo, wide = 0, 1
    while lo <= turn.max():  # waves of 1, 3, 9, ... leaves: between them, and from leaf to leaf, the kth score rises
        now = np.nonzero((turn >= lo) & (turn < lo + wide))[0]
        lo, wide = lo + wide, 3 * wide
        now = now[reach[now] >= kth[who[now]]]
        now = now[np.argsort(node[now], kind="stable")]
        edge = np.concatenate([[0], np.nonzero(np.diff(node[now]))[0] + 1, [len(now)]]) if len(now) else [0]
        for begin, end in zip(edge, edge[1:], strict=False):
            own_rows = now[begin:end]
            own_rows = own_rows[reach[own_rows] >= kth[who[own_rows]]]
            if not len(own_rows):
                continue
            leaf_node, mine = node[own_rows[0]], who[own_rows]
            for at in range(first[leaf_node], last[leaf_node], 4096):
                to = min(at + 4096, last[leaf_node])
                own = ids[None, at:to] == qids[mine, None]
                s = _products(q[mine], tree["x"][at:to].astype(np.float64), own)
                s[own | (s < kth[mine, None])] = LOWEST
                s = np.concatenate([score[mine], s], 1)
                i = np.concatenate([best[mine], np.broadcast_to(ids[at:to], (len(mine), to - at))], 1)
                i = np.where(s == LOWEST, np.iinfo(np.int64).max, i)
                top = np.lexsort((i, -s), axis=-1)[:, :k]
                score[mine], best[mine] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                kth[mine] = np.maximum(kth[mine], score[mine, -1])
    return score, best


#: Arrays of a tree and their types; the vectors `x` stand as 32-bit integers where they fit.
NODES = {"low": "<f8", "high": "<f8", "left": "<i8", "right": "<i8", "first": "<i8", "last": "<i8", "ids": "<i8"}


def _built(leaf: int):
    def run(group: pa.Table) -> pa.Table:
        tree = _tree(group["id"].to_numpy(), _rows(group["v"]), leaf)
        return pa.table({
            **{c: group[c][:1] for c in ("dim", "cell", "part")},
            "least": pa.array([tree["low"][0]], pa.list_(pa.float64())), "most": pa.array([tree["high"][0]], pa.list_(pa.float64())),
            **{c: pa.array([tree[c].astype(t).tobytes()], pa.binary()) for c, t in NODES.items()},
            "x": pa.array([tree["x"].tobytes()], pa.binary()), "small": pa.array([tree["x"].itemsize == 4]),
        })

    return run


def _read(row: dict) -> dict:
    """The tree of a row that `_built` wrote."""
    import numpy as np

    tree = {c: np.frombuffer(row[c], t) for c, t in NODES.items()}
    tree["low"], tree["high"] = (tree[c].reshape(-1, row["dim"]) for c in ("low", "high"))
    return tree | {"x": np.frombuffer(row["x"], "<i4" if row["small"] else "<f8").reshape(-1, row["dim"])}


def _searched(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out = [[], [], []]
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            tree, dim = _read(row), row["dim"]
            for row in right.select(["ids", "vectors", "bounds"]).to_pylist():
                qids, q, bound = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), np.frombuffer(row["bounds"], "<i8")
                score, best = _search(tree, qids, q, k, bound)
                at, col = np.nonzero(score > LOWEST)
                for c, x in zip(out, (qids[at], best[at, col], score[at, col]), strict=True):
                    c.append(x)
        return pa.table([pa.array(np.concatenate([np.empty(0, np.int64), *c])) for c in out], ["query", "id", "score"])

    return run


def _spread(trees: DataFrame, cells: DataFrame, route: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Trees of the cells that `route` names, and its rows, both by dim, cell, part, piece: a tree once for every `block` queries that visit its cell, a query for each part of the cell."""
    visits = route.groupBy("dim", "cell").agg(F.ceil(F.sum(F.length("ids") / 8) / block).cast("int").alias("pieces"))
    visits = F.broadcast(saved(visits.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]), "visits"))  # a row a cell, as the boxes on the driver
    sent = trees.join(visits, ["dim", "cell"]).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).drop("pieces", "parts")
    asked = route.join(visits, ["dim", "cell"]).withColumn("piece", F.expr("int(pmod(xxhash64(ids), pieces))"))
    return sent, asked.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("pieces", "parts")


def top_k(
    vectors: DataFrame, queries: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, shard: int = 8192, block: int = 4096, leaf: int = 128
) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row that meets the SQL condition `queries` (on the column id) the k rows other than
    itself with the largest integer inner product; ties go to the smaller id.

    Vectors take part that are not null or empty and hold only finite components; a score that doesn't fit a long is an error.
    Vectors of different lengths are not compared. Repeated ids count once; null ids take no part. A query with fewer
    candidates than k gets all of them; none, no row. Other columns are not read. An empty table gives an empty result.
    """
    import numpy as np

    whole = saved(integer_vectors(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")), "integer-vectors")
    n, asked = whole.count(), whole.where(queries).count()
    depth = min(MOST_LEVELS, max(0, -(-n // shard) - 1).bit_length())
    sample = first_by_hash(whole, "id", SAMPLE).toArrow()
    dims = sample["dim"].to_numpy()
    cuts = {int(d): _cuts(_rows(sample.filter(pa.array(dims == d))["v"]), depth) for d in np.unique(dims)}

    def placed(batches):
        for batch in batches:
            dim, cell = batch.column("dim").to_numpy(), np.ones(batch.num_rows, np.int64)
            for d in np.unique(dim).tolist():
                if d in cuts:  # a length that the sample lacks is one cell
                    mine = dim == d
                    cell[mine] = _cell(_rows(batch.column("v").filter(pa.array(mine))), *cuts[d], depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "dim", "cell"])

    celled = saved(whole.mapInArrow(placed, "id long, v array<double>, dim int, cell int"), "celled-vectors")
    size = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * shard)).cast("int").alias("parts")).where("parts > 1")
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = celled.withColumn("salt", F.expr(f"int(pmod(xxhash64(id, 3), {SALTS}))")).join(size, ["dim", "cell", "salt"], "left")
    dealt = dealt.select("id", "v", "dim", "cell", F.expr("coalesce(int(pmod(xxhash64(id), parts)), 0)").alias("part"))
    key = ["dim", "cell", "part"]
    shape = "dim int, cell int, part int, least array<double>, most array<double>, " + ", ".join(f"{c} binary" for c in (*NODES, "x")) + ", small boolean"
    trees = saved(dealt.groupBy(*key).applyInArrow(_built(leaf), shape), "trees")
    # boxes of the cells: 2 ** MOST_LEVELS at most for each length of vectors
    corner = trees.select("dim", "cell", "part", F.posexplode(F.arrays_zip("least", "most"))).groupBy("dim", "cell", "pos")
    corner = corner.agg(F.min("col.least").alias("least"), F.max("col.most").alias("most"), F.max("part").alias("part"))
    cells = corner.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "least", "most"))).alias("box"), (F.max("part") + 1).alias("parts"))
    cells = saved(cells.select("dim", "cell", "parts", "box.least", "box.most"), "cells")
    boxes = {}
    for r in cells.toArrow().to_pylist():
        boxes.setdefault(r["dim"], []).append((r["cell"], r["least"], r["most"]))
    boxes = {d: tuple(np.array(c) for c in zip(*b, strict=True)) for d, b in boxes.items()}

    def routed(lo: int, hi: int):
        def run(batches):
            names = ["dim", "cell", "ids", "vectors", "bounds"]
            for batch in batches:
                dim = batch.column("dim").to_numpy()
                for d in np.unique(dim).tolist():
                    some = batch.filter(pa.array(dim == d))
                    cell, low, high = boxes[d]
                    for at in range(0, some.num_rows, ROUTE):
                        few = some.slice(at, ROUTE)
                        ids, q, kth = few.column("id").to_numpy(), _rows(few.column("v")), few.column("bound").to_numpy()
                        reach = _reach(q, low, high)
                        rank = np.argsort(np.argsort(-reach, axis=1, kind="stable"), axis=1)
                        visit = (rank >= lo) & (rank < hi) & (reach >= kth[:, None])
                        out = [[] for _ in names]
                        for b in np.nonzero(visit.any(0))[0]:
                            go = visit[:, b]
                            for c, x in zip(out, (d, cell[b], ids[go].tobytes(), q[go].tobytes(), kth[go].tobytes()), strict=True):
                                c.append(x)
                        if out[0]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)], names)

        return run

    own = lambda d, *names: d.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  columns of their own on each side
    ask = whole.where(queries)
    best = None
    lo, hi, most = 0, 1, max((len(b[0]) for b in boxes.values()), default=0)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    while lo < most:
        bound = F.lit(LOWEST).alias("bound")
        kth = None if best is None else best.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("bound"))
        now = ask.withColumn("bound", bound) if kth is None else ask.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", bound))
        # queries are routed and searched in blocks: full batches, not a join's small partitions
        route = now.select("id", "v", "dim", "bound").repartition(max(1, asked // (4 * ROUTE)), "id").mapInArrow(routed(lo, hi), "dim int, cell int, ids binary, vectors binary, bounds binary")
        sent, wanted = _spread(trees.drop("least", "most"), cells, saved(route, "route"), block)
        found = own(sent, *key, "piece", *NODES, "x", "small").groupBy(*key, "piece").cogroup(own(wanted, *key, "piece", "ids", "vectors", "bounds").groupBy(*key, "piece")).applyInArrow(_searched(k), "query long, id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = saved(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        lo, hi = hi, 4 * hi if hi < 16 else most
    if best is None:
        return whole.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return best.select(F.col("query").alias("query_id"), "rank", "id", "score")
