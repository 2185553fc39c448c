"""Shared helpers: scratch tables in the cluster's shared folder, connected components, block pairs, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.storage import removed, saved, shared_folder, stored

__all__ = ["WORD", "WordHashes", "block_pairs", "connected_components", "first_by_hash", "forest", "mixed", "saved", "shared_folder", "slices", "small_batches", "word_hashes"]

#: Characters that end a word: space and \t \n \v \f \r. Everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks that the rows of one large key are dealt to where they meet a small table.
SALTS = 32


def small_batches(docs: DataFrame, rows: int = 1000, size: str = "8m") -> DataFrame:
    """docs, after the session's Arrow batches were bounded (where they aren't bounded lower): whole texts go to Python workers in batches, and with 10 000 rows
    or 64 MB each, the batches under way in an executor take more memory than the work itself."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return docs


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows (no copies) whose values in `column` hold about `limit` bytes, so that a task's memory doesn't follow the batch."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def first_by_hash(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, those whose keys hash lowest. Rows far above the expected bound are filtered out in the scan, so the
    sorting tasks hold and send about `bound` rows between them, however many tasks there are."""
    share = min(1.0, 1.2 * bound / max(1, df.count()))
    h = F.xxhash64(key)
    few = df if share == 1.0 else df.where(h <= F.lit(int(-(2**63) + share * 2**64)))
    return few.orderBy(h, key).limit(bound)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: (id, component) for every id on an edge between two different ids;
    component is the smallest id reachable.

    Contraction by random order: every vertex moves to the first of itself and its neighbours in an order drawn
    anew each round, edges are relabelled, loops and repeats go. The number of vertices falls by a constant
    factor a round, whatever the graph's shape, so chains end in O(log n) rounds as stars do. A vertex with many edges is
    pre-aggregated in the map tasks; the joins are plain equi-joins that AQE can split on skew.
    """
    spark = edges.sparkSession
    edge, edge_at = stored(
        edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges"
    )
    owner: DataFrame | None = None
    owner_at: list[str] = []
    turn = 0
    while not edge.isEmpty():
        first = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("id"))
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move, move_at = stored(
            both.groupBy("u").agg(F.min(first("v")).alias("near")).select("u", F.least(first("u"), "near")["id"].alias("to")), "moves"
        )
        owner_next = (
            move.select(F.col("u").alias("id"), F.col("to").alias("root"))
            if owner is None
            else owner.join(move.withColumnRenamed("u", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        )
        owner, at = stored(owner_next, "owners")
        left, right = move.select("u", F.col("to").alias("tu")), move.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        edge, next_at = stored(
            edge.join(left, "u").join(right, "v").where("tu != tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(),
            "edges",
        )
        removed(spark, edge_at, move_at, *owner_at)  # every reader of the round's tables is done
        edge_at, owner_at = next_at, [at]
        turn += 1
    if owner is None:
        return edge.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = owner.groupBy("root").agg(F.min("id").alias("component"))
    return owner.join(least, "root").select("id", "component")


def block_pairs(members: DataFrame, weight: Column, max_rows: int, max_weight: int) -> DataFrame:
    """Deal members (id, component, ...) of each component into blocks of about max_rows rows and max_weight weight, and
    repeat each row for every pair of blocks that its block is part of: adds blk, i, j with i <= j.

    A small component is one pair (0, 0). A component of n blocks becomes n(n+1)/2 independent tasks, each of
    two blocks at most, so no task holds a whole large component.
    """
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))
    size = size.select(
        "component", F.greatest(F.ceil(F.col("rows") / max_rows), F.ceil(F.col("weight") / max_weight), F.lit(1)).cast("int").alias("n_blk")
    )
    # only components of several blocks are joined, each under several salts: a large one's rows are dealt to many tasks
    many = size.where("n_blk > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.expr(f"int(pmod(xxhash64(id, 3), {SALTS}))"))
    dealt = salted.join(many, ["component", "salt"], "left").drop("salt").withColumn("n_blk", F.coalesce("n_blk", F.lit(1)))
    dealt = dealt.withColumn("blk", F.expr("int(pmod(xxhash64(id), n_blk))"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, n_blk - 1)")))
    return other.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).drop("other", "n_blk")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list, memo: WordHashes):
    """Hashes of a document's words as uint64."""
    import numpy as np

    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x):
    """Finaliser that spreads every bit of uint64 values over the whole word."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def forest(links, ids):
    """Spanning forest of a symmetric boolean matrix: (ids, smallest id of each one's group) for groups of two or more."""
    import numpy as np

    n = len(ids)
    todo = np.ones(n, bool)
    a, b = [], []
    for k in range(n):
        if not todo[k]:
            continue
        todo[k] = False
        front, group = np.array([k]), [k]
        while len(front):
            near = links[front].any(0) & todo
            front = np.nonzero(near)[0]
            todo[front] = False
            group.extend(front.tolist())
        if len(group) > 1:
            got = ids[group]
            a.append(got)
            b.append(np.full(len(got), got.min()))
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])
