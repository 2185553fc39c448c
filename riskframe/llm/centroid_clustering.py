"""Exact k-means rounds on whole numbers by bit planes.

A vector of 64 whole numbers becomes planes: bit d of plane k is bit k of component d, in two's complement, and a plane is one unsigned 64-bit word. With plane weights s (1, 2, 4, ..., the last
negative), x . c is the sum of s[j] s[k] popcount(X[j] & C[k]) over all pairs of planes, so |x|^2 - 2 x . c + |c|^2 is an exact squared distance; and sums of vectors are
counts of set bits per plane and component. Vectors are packed once, in as many planes as a batch needs; each round reads the planes, which are smaller than the vectors.
A round sends one row for each task, centroid and component; k centroids of 64 numbers pass through the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components of a vector: bits of a plane.
WIDTH = 64
#: Vectors that are worked on at once.
STEP = 4096
#: Planes beyond which products may not fit 64 bits; such batches are counted in Python's numbers.
NARROW = 27


def pack(values) -> object:
    """(n, planes) unsigned words of an (n, 64) array of whole numbers (int64, or objects where they are larger)."""
    import numpy as np

    most = max((int(values.max()), -int(values.min()) - 1), default=0) if values.size else 0
    planes = max(2, most.bit_length() + 1)
    bit = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
    out = np.zeros((len(values), planes), np.uint64)
    for k in range(planes):
        out[:, k] = ((values >> k) & 1).astype(np.uint64) @ bit
    return out


def plane_weights(planes: int) -> list[int]:
    return [1 << k for k in range(planes - 1)] + [-(1 << (planes - 1))]


def popcount_dots(x, c):
    """Exact products of every row of x with every row of c, both in planes."""
    import numpy as np

    wide = x.shape[1] + c.shape[1] > 2 * NARROW
    out = np.zeros((len(x), len(c)), object if wide else np.int64)
    for j, s in enumerate(plane_weights(x.shape[1])):
        for k, t in enumerate(plane_weights(c.shape[1])):
            ones = np.bitwise_count(x[:, j, None] & c[None, :, k])
            out += ones.astype(object) * (s * t) if wide else ones.astype(np.int64) * (s * t)
    return out


def popcount_squares(x):
    """Exact squared lengths of rows in planes."""
    import numpy as np

    wide = 2 * x.shape[1] > 2 * NARROW
    out = np.zeros(len(x), object if wide else np.int64)
    weights = plane_weights(x.shape[1])
    for j, s in enumerate(weights):
        for k, t in enumerate(weights):
            ones = np.bitwise_count(x[:, j] & x[:, k])
            out += ones.astype(object) * (s * t) if wide else ones.astype(np.int64) * (s * t)
    return out


def plane_sums(x):
    """Exact component sums of rows in planes: set bits are counted by plane and component. Python's numbers."""
    import numpy as np

    total = [0] * WIDTH
    for k, s in enumerate(plane_weights(x.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(x[:, k]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = [a + s * b for a, b in zip(total, bits.sum(0, dtype=np.int64).tolist(), strict=True)]
    return total


def _planes(column):
    """Planes of a column of packed rows, all in as many planes as the widest: a sign plane repeats."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    wide = int(size.max())
    out = np.empty((len(column), wide), np.uint64)
    rows = column.to_pylist()
    for n in np.unique(size).tolist():
        own = np.nonzero(size == n)[0]
        got = np.frombuffer(b"".join(rows[k] for k in own.tolist()), "<u8").reshape(-1, n)
        out[own, :n] = got
        out[own, n:] = got[:, n - 1 :]
    return out


def packed_vectors(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, planes): vectors of exactly 64 components, none null or non-finite, as floor(scale * x) in planes."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = v.where((F.size("e") == WIDTH) & F.forall("e", lambda x: F.coalesce(finite(x), F.lit(False))))

    def run(batches):
        import numpy as np

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, STEP):
                batch = whole_batch.slice(at, STEP)
                x = np.floor(scale * batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
                if not np.isfinite(x).all():
                    raise ValueError(f"{scale} times a component is beyond what doubles hold")
                x = x.astype(np.int64) if np.abs(x).max() < 2.0**62 else np.array([[int(c) for c in row] for row in x.tolist()], object)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in pack(x).astype("<u8")], pa.binary())], ["id", "planes"])

    return whole.mapInArrow(run, "id long, planes binary")


def _nearest(x, centroids):
    """(number of the nearest centroid, squared distance) of each row; the smaller number wins ties. centroids: lists of Python numbers."""
    import numpy as np

    values = np.array(centroids, object)
    if max(abs(int(values.max())), abs(int(values.min()))) < 2**62:
        values = values.astype(np.int64)
    c = pack(values)
    length = popcount_squares(c)
    part = length[None, :] - 2 * popcount_dots(x, c)  # |x|^2 is the same for all centroids
    best = part.argmin(1)
    return best, popcount_squares(x) + part[np.arange(len(x)), best]


def _cut(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            yield whole.slice(at, STEP)


def round_sums(packed: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """Component sums of each non-empty cluster of one assignment, with the count at the end. At most len(centroids) * 65 rows come to the driver."""

    def run(batches):
        total: dict[int, list[int]] = {}
        for batch in _cut(batches):
            x = _planes(batch.column("planes"))
            best, _ = _nearest(x, centroids)
            for c in set(best.tolist()):
                own = x[best == c]
                got = [*plane_sums(own), len(own)]
                total[c] = [a + b for a, b in zip(total[c], got, strict=True)] if c in total else got
        rows = [(c, d, v) for c, sums in total.items() for d, v in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows], pa.string())], ["cluster", "component", "total"])

    found: dict[int, list[int]] = {}
    summed = packed.mapInArrow(run, "cluster int, component int, total string").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for r in summed.collect():
        found.setdefault(r.cluster, [0] * (WIDTH + 1))[r.component] = int(r.total)
    return found


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, seed: str = "1", scale: int = 64) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of exactly 64 components, none null or non-finite; others take no part.

    Components are floor(scale * x). The first centroids are the k vectors with the smallest sha256 of `seed:id` (all, if fewer; rows of one id in the order of their components; a null id stands last). Each round
    assigns every vector to the nearest centroid by squared Euclidean distance, ties to the smaller number, and puts floor(sum / count) in the place of every centroid that has vectors; others stay. Then vectors
    are assigned once more. Every row counts for itself, repeated ones too. An empty table, or one without such vectors, gives an empty result; other columns don't matter. A distance or a sum of them that
    does not fit a long is an error, as is a product of scale and a component that is beyond doubles.
    """
    spark = vectors.sparkSession
    packed = saved(packed_vectors(vectors, scale, id_col, vec_col), "planes")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = packed.orderBy(order.asc_nulls_last(), "planes").limit(k).collect()  # k rows
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [_values(r.planes) for r in first]
    for _ in range(rounds):
        for c, sums in round_sums(packed, centroids).items():
            centroids[c] = [s // sums[-1] for s in sums[:-1]]

    def run(batches):
        for batch in _cut(batches):
            best, distance = _nearest(_planes(batch.column("planes")), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.tolist(), pa.int32()), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    done = saved(packed.mapInArrow(run, "id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.total for r in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    whole = sum(inertia.values())
    rows = [(c, n, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _values(planes: bytes) -> list[int]:
    """Components of one packed vector."""
    words = [int.from_bytes(planes[k : k + 8], "little") for k in range(0, len(planes), 8)]
    return [sum(s * (w >> d & 1) for s, w in zip(plane_weights(len(words)), words, strict=True)) for d in range(WIDTH)]
