"""Embedding near-duplicates by sorted projection passes.

1. The vectors of a label are scaled to length one and seen from the label's mean, so that a label crowded round one direction is spread out.
2. A pass draws 60 random directions. The signs of a vector's products with them, one after the other, are its key; the vectors of a label are
   ordered by it, and each is compared with the `window` vectors before it (and more) by matrix products. Products are taken in single
   precision; those within its rounding error of the threshold are decided in double precision. Linked pairs are joined in place; a forest leaves the task.
3. The passes measure themselves. For each vector the key tells how many signs a partner must share to stand inside the window, and the distance
   from the mean how likely a partner just at the threshold shares one. So every label has an estimated share of missed pairs for 4, 8, ...
   passes; after four passes each label gets as many more as bring that to `miss`. A label that no number of them would (one far denser than
   its windows, or cut into shorter runs than a window) is compared block by block, exactly.
4. Forests of all passes are united; inside a component all pairs are compared in bounded blocks, which gives each vector's exact number of links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, block_pairs, connected_components, saved

#: Rows that can link.
USABLE = """id is not null and label is not null and v is not null and size(v) > 0
    and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"""
#: Rows of one side in a matrix product.
STEP = 512
#: Components a row that a block of full length allows for.
ROOM = 256
#: Signs in a key.
SIGNS = 60
#: Numbers of passes to choose from; all labels get the first.
PASSES = (4, 8, 16, 32, 64, 128)
#: Share of a partition's rows whose window its edge may cut.
EDGE = 1 / 16


def _unit(rows):
    """Rows scaled to length one, in double precision. Scaled by the largest component first: squares can't overflow."""
    import numpy as np

    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column, dim: int, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _named(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    wide = isinstance(vectors.select(v).schema[0].dataType.elementType, T.FloatType)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.cast("array<float>" if wide else "array<double>").alias("v"))


def _usable(named: DataFrame, kind: str) -> DataFrame:
    """id, label, dim, vec (bytes of floats or doubles, as the column has) of rows that can link."""

    def run(batches):
        for batch in batches:
            vec = [x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for x in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([len(x) // int(kind[-1]) for x in vec], pa.int32()), pa.array(vec, pa.binary())], ["id", "label", "dim", "vec"])

    return named.where(F.expr(USABLE)).mapInArrow(run, "id long, label string, dim int, vec binary")


def _united(root, a, b) -> None:
    """Joins the sets of a[k] and b[k] in `root`, where each index points at one no larger."""
    import numpy as np

    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _links(unit, single, left, right, threshold: float):
    """Linked pairs of the rows left and right, strip by strip."""
    import numpy as np

    error = (unit.shape[1] + 8) * 2.0**-23
    for at in range(0, len(left), STEP):
        some = left[at : at + STEP]
        cosine = single[some] @ single[right].T
        row, col = np.nonzero(cosine >= threshold - error)
        doubtful = np.nonzero(cosine[row, col] < threshold + error)[0]
        a, b = some[row], right[col]
        link = a != b
        for lo in range(0, len(doubtful), 1 << 16):
            k = doubtful[lo : lo + (1 << 16)]
            link[k] &= np.einsum("ij,ij->i", unit[a[k]], unit[b[k]]) >= threshold
        yield a[link], b[link]


def _counted(threshold: float, kind: str):
    """Kernel over one pair of blocks: links of each vector that has any, and the id of its set's root."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        ids, blk, times = group["id"].to_numpy(), group["blk"].to_numpy(), group["times"].to_numpy()
        unit = _unit(_matrix(group["vec"], group["dim"][0].as_py(), kind))
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        one = group["i"][0].as_py() == group["j"][0].as_py()
        left, right = (root.copy(), root.copy()) if one else (np.nonzero(blk == blk.min())[0], np.nonzero(blk != blk.min())[0])
        for a, b in _links(unit, unit.astype(np.float32), left, right, threshold):
            np.add.at(n, a, times[b])
            if not one:
                np.add.at(n, b, times[a])
            _united(root, a, b)
        has = n > 0
        return pa.table({"id": pa.array(ids[has]), "n": pa.array(n[has]), "to": pa.array(ids[root[has]])})

    return run


def _centres(members: DataFrame, kind: str) -> DataFrame:
    """label, dim, n (vectors), centre (mean of the vectors of length one, bytes of doubles). Sums are taken a task first."""

    def run(batches):
        import numpy as np

        sums = {}

        def rows():
            keys = list(sums)
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())]
            sums.clear()
            return pa.RecordBatch.from_arrays(out, ["label", "dim", "n", "total"])

        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                some = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                unit = _unit(_matrix(some.column("vec"), dim, kind))
                names, of = np.unique(np.array(some.column("label").to_pylist(), object), return_inverse=True)
                total = np.zeros((len(names), dim))
                np.add.at(total, of, unit)
                for name, n, own in zip(names, np.bincount(of), total, strict=True):
                    m, x = sums.get((name, dim), (0, 0.0))
                    sums[name, dim] = m + int(n), x + own
            if len(sums) > 10_000:
                yield rows()
        if sums:
            yield rows()

    def mean(group: pa.Table) -> pa.Table:
        import numpy as np

        n = group["n"].to_numpy().sum()
        centre = np.stack([np.frombuffer(x, "<f8") for x in group["total"].to_pylist()]).sum(0) / n
        return pa.table({"label": group["label"][:1], "dim": group["dim"][:1], "n": pa.array([int(n)]), "centre": pa.array([centre.tobytes()], pa.binary())})

    part = members.select("label", "dim", "vec").mapInArrow(run, "label string, dim int, n long, total binary")
    return part.groupBy("label", "dim").applyInArrow(mean, "label string, dim int, n long, centre binary")


def _pass(members: DataFrame, window: int, threshold: float, kind: str, rows: int) -> DataFrame:
    """One row for each vector joined to another (a, b), and one for each run of a label (label, dim, seen, missed) with the estimate.
    members: id, label, dim, vec, n, centre, first and last (numbers of the passes to make, last left out)."""
    spark = members.sparkSession

    def keys(batches):
        import numpy as np

        for batch in batches:
            dims, lo, hi = (batch.column(c).to_numpy() for c in ("dim", "first", "last"))
            for dim in np.unique(dims).tolist():
                mine = dims == dim
                some, low, high = batch.filter(pa.array(mine)), lo[mine], hi[mine]
                x = _unit(_matrix(some.column("vec"), dim, kind)) - _matrix(some.column("centre"), dim, "<f8")
                far = np.maximum((x * x).sum(1), 1e-12)
                for turn in range(int(low.min()), int(high.max())):
                    take = (low <= turn) & (turn < high)
                    if not take.any():
                        continue
                    signs = x[take] @ np.random.default_rng((turn, dim)).standard_normal((dim, SIGNS)) >= 0
                    key = (signs.astype(np.int64) << np.arange(SIGNS - 1, -1, -1)).sum(1)
                    got = some.filter(pa.array(take))
                    n = got.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [got.column("id"), got.column("label"), got.column("dim"), pa.array(np.full(n, turn, np.int32)), pa.array(key), got.column("vec"), got.column("n"), pa.array(far[take].astype(np.float32))],
                        ["id", "label", "dim", "turn", "key", "vec", "n", "far"],
                    )

    def sweep(batches):
        import numpy as np

        state: dict = {"run": None}

        def closed(run):
            """The run's estimate. All pairs of a run that is a whole label inside one window are compared."""
            if run and run["rows"] == run["n"] <= window:
                run["seen"], run["missed"] = run["rows"], np.zeros(len(PASSES))
            if run and run["seen"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([run["label"]]), pa.array([run["dim"]], pa.int32()), pa.array([run["seen"]], pa.int64()), pa.array([run["missed"].tolist()], pa.list_(pa.float64()))],
                    ["a", "b", "label", "dim", "seen", "missed"],
                )

        def chunk(run, some):
            """Compares a chunk of `window` rows (fewer at the run's end) with itself and the chunk before."""
            ids, key, far = some["id"].to_numpy(), some["key"].to_numpy(), some["far"].to_numpy().astype(np.float64)
            unit = _unit(_matrix(some["vec"], run["dim"], kind))
            run["rows"] += len(ids)
            if run["before"] is None:
                every, own = unit, ids
            else:
                every, own = np.concatenate([run["before"][1], unit]), np.concatenate([run["before"][0], ids])
                apart = (key ^ run["before"][2][: len(key)]).astype(np.float64)
                needed = SIGNS + 1 - np.where(apart > 0, np.floor(np.log2(np.maximum(apart, 1))) + 1, 0)  # signs to share so as to be nearer than a window
                share = 1 - np.arccos(np.clip(1 - (1 - threshold) / far, -1, 1)) / np.pi
                found = (1 - EDGE) * share ** np.minimum(needed, SIGNS)
                run["seen"] += len(key)
                run["missed"] = run["missed"] + np.array([((1 - found) ** p).sum() for p in PASSES])
            root = np.arange(len(own))
            for a, b in _links(every, every.astype(np.float32), np.arange(len(own) - len(ids), len(own)), root.copy(), threshold):
                _united(root, a, b)
            run["before"] = (ids, unit, key)
            moved = np.nonzero(root != np.arange(len(own)))[0]
            if len(moved):
                k = len(moved)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[moved]), pa.array(own[root[moved]]), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.float64()))],
                    ["a", "b", "label", "dim", "seen", "missed"],
                )

        held: list = []

        def flush(run, last: bool):
            """Chunks out of the rows held: all at the run's end, else whole ones."""
            table = pa.Table.from_batches(held)
            held.clear()
            at = 0
            while table.num_rows - at >= (1 if last else window):
                yield from chunk(run, table.slice(at, window))
                at += window
            if at < table.num_rows:
                held.extend(table.slice(at).to_batches())

        for batch in batches:
            label, dim, turn = batch.column("label").to_pylist(), batch.column("dim").to_pylist(), batch.column("turn").to_pylist()
            cut = [k for k in range(1, batch.num_rows) if turn[k] != turn[k - 1] or dim[k] != dim[k - 1] or label[k] != label[k - 1]]
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                name = label[lo], dim[lo], turn[lo]
                run = state["run"]
                if run is None or run["name"] != name:
                    if held:
                        yield from flush(run, True)
                    yield from closed(run)
                    run = state["run"] = {"name": name, "label": name[0], "dim": name[1], "n": batch.column("n")[lo].as_py(), "rows": 0, "seen": 0, "missed": np.zeros(len(PASSES)), "before": None}
                held.append(batch.slice(lo, hi - lo))
                if sum(x.num_rows for x in held) >= window:
                    yield from flush(run, False)
        if held:
            yield from flush(state["run"], True)
        yield from closed(state["run"])

    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, int(rows * EDGE) // window)) if rows < 10**8 else max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 500_000)
    keyed = members.mapInArrow(keys, "id long, label string, dim int, turn int, key long, vec binary, n long, far float")
    order = ["label", "dim", "turn", "key", "id"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(sweep, "a long, b long, label string, dim int, seen long, missed array<double>")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    window: int = 1024, miss: float = 0.001, block_rows: int = 4096,
) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link when their labels are equal and not null, their lengths are equal, and the cosine is at or above the threshold. Vectors
    that are null, empty, all zero or hold null or non-finite components link with nothing, nor do rows with a null id.
    Equal vectors of one label are one class whose copies all link; they are counted, not paired. A repeated id with
    equal vectors counts as that many rows; with different ones, each row is counted by its own vector. No pair below the threshold is linked; of the pairs just
    at it a share of about `miss` may be missed by all passes, unless other links join their components. Other columns are not read. An empty table gives an empty result.
    """
    named = _named(vectors, id_col, vector_col, label_col)
    kind = "<f4" if isinstance(named.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    rows = saved(_usable(named, kind), "vectors")
    classes = saved(rows.groupBy("label", "dim", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times")), "vector-classes")
    # a class is numbered by itself: ids may stand with several vectors
    classes = saved(classes.withColumn("no", F.monotonically_increasing_id()), "vector-classes")
    centres = saved(_centres(classes, kind), "centres")
    salted = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = classes.select(F.col("no").alias("id"), "label", "dim", "vec").withColumn("salt", F.expr(f"int(pmod(xxhash64(id), {SALTS}))"))
    members = seen.join(salted, ["label", "dim", "salt"]).drop("salt")
    total = classes.count()
    once = saved(_pass(members.withColumns({"first": F.lit(0), "last": F.lit(PASSES[0])}), window, threshold, kind, total * PASSES[0]), "pass-links")
    # passes each label needs; null: none of the numbers will do
    stats = once.where("seen is not null").groupBy("label", "dim").agg(F.sum("seen").alias("seen"), *(F.sum(F.col("missed")[k]).alias(f"m{k}") for k in range(len(PASSES))))
    needed = F.coalesce(*(F.when(F.col(f"m{k}") <= miss * F.col("seen"), F.lit(p)) for k, p in enumerate(PASSES)))
    plan = saved(centres.select("label", "dim").join(stats.select("label", "dim", needed.alias("last")), ["label", "dim"], "left"), "pass-plan")
    more = saved(members.join(plan.where(f"last > {PASSES[0]}").withColumn("first", F.lit(PASSES[0])), ["label", "dim"]), "pass-members")
    edges = once.where("a is not null").select("a", "b")
    left = more.agg(F.sum(F.col("last") - F.col("first"))).first()[0] or 0
    if left:
        edges = edges.unionByName(saved(_pass(more, window, threshold, kind, left), "pass-links").where("a is not null").select("a", "b"))
    dense = classes.join(plan.where("last is null"), ["label", "dim"]).select(F.col("no").alias("id"), "dim", "vec", "times", F.to_json(F.struct("dim", "label")).alias("component"))
    exact = lambda m: block_pairs(m, F.col("dim"), block_rows, block_rows * ROOM).groupBy("component", "i", "j").applyInArrow(_counted(threshold, kind), "id long, n long, to long")
    whole = saved(exact(dense), "dense-links")
    group = connected_components(edges.unionByName(whole.where("id != to").select(F.col("id").alias("a"), F.col("to").alias("b"))))
    linked = saved(classes.join(group.withColumnRenamed("id", "no"), "no").select(F.col("no").alias("id"), "dim", "vec", "times", "component", F.col("id").alias("least")), "linked-vectors")
    n = exact(linked.drop("least")).groupBy("id").agg(F.sum("n").alias("n"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = linked.select("id", "component").join(least, "component").join(n, "id", "left").select(F.col("id").alias("no"), "n", "component_id")
    of_class = classes.join(of_class, "no", "left").select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    usable = rows.join(of_class, ["label", "dim", "vec"]).select("id", "n_links", "component_id")
    rest = named.where(~F.coalesce(F.expr(USABLE), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
