"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

1. Each document's set of k-word shingles (64-bit hashes) gives a signature of 64 minima, 16 bits each.
2. Signatures of two sets with similarity s differ in about 64 * (1 - s) places. `radius` lies 4.9 standard deviations
   above that at the threshold, so a linked pair has a larger distance with a probability of about 1e-5.
3. Pigeonhole: the 64 places are split into m chunks with 2 * m > radius; two signatures at most `radius` apart have one chunk
   with one error at most. Enumerating the errors of a chunk means leaving each of its places out in turn: 64 keys a document
   guarantee that every pair within the radius shares a key.
4. Distances are taken among the holders of one key: each holder's to the key's centre first, then, for holders beyond the radius from the
   centre, to all other holders in bounded blocks (two holders near the centre are in one group by it). Only pairs within the radius make candidate
   groups, so documents that share some keys by chance or by boilerplate don't.
5. A group is cut into pairs of bounded blocks. There pairs within the radius are confirmed on the full shingle sets. Only a spanning forest of
   the links leaves a task.
6. Components of the confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, block_pairs, connected_components, forest, mixed, saved, small_batches, word_hashes

PLACES = 64
#: Rows of Arrow batches are cut into steps of so many shingles, so that memory doesn't follow the text's length.
STEP = 4096


def radius(percent: int, places: int = PLACES) -> int:
    """Largest signature distance that is searched for a similarity of percent / 100."""
    p = 1 - percent / 100
    return math.ceil(places * p + 4.9 * math.sqrt(places * p * (1 - p)))


def shingle_set(text: str | None, k: int, memo: WordHashes):
    """Sorted distinct hashes of the k-word shingles; of a shorter text's whole word sequence; empty without words."""
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, only \x20 \x09-\x0D part
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, memo)
    k_here = min(k, len(h))
    s = np.full(len(h) - k_here + 1, k_here, np.uint64)
    for j in range(k_here):
        s = mixed(s + h[j : len(h) - k_here + 1 + j])
    return np.unique(s)


def signature(s, mul, add):
    """64 minima under multiply-add orders, the upper 16 bits of each minimum's own hash."""
    import numpy as np

    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STEP):
        np.minimum(low, (s[at : at + STEP, None] * mul + add).min(0), out=low)
    return (mixed(low) >> np.uint64(48)).astype("<u2")


def _orders():
    import numpy as np

    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2)
    return draw() | np.uint64(1), draw()


def _digest(s) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _chunks(r: int) -> list[range]:
    m = r // 2 + 1
    edge = [PLACES * c // m for c in range(m + 1)]
    return [range(a, b) for a, b in zip(edge, edge[1:], strict=False)]


def chunk_keys(sig, r: int):
    """For each signature (rows of uint16) 64 keys: each chunk with each one of its places left out."""
    import numpy as np

    rng = np.random.default_rng(7)
    salt = rng.integers(0, 2**63, PLACES, dtype=np.uint64)
    term = mixed(sig.astype(np.uint64) + salt)
    keys = np.empty(sig.shape, np.uint64)
    for places in _chunks(r):
        own = term[:, places.start : places.stop]
        keys[:, places.start : places.stop] = own.sum(1, dtype=np.uint64)[:, None] - own + salt[places.start : places.stop]
    return mixed(keys).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n_shingles, digest (of the set; null if empty), sig (128 bytes; null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (mul, add) = WordHashes(), _orders()
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k, memo)
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                sig.append(signature(s, mul, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "n_shingles", "digest", "sig"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n_shingles long, digest binary, sig binary")


def _unpacked(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PLACES)


def _stars(reps: DataFrame, r: int) -> DataFrame:
    """key, id, c: each holder of a key but its centre, with the centre. The centre is drawn anew for each key."""

    def run(batches):
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_unpacked(batch.column(1)), r)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * PLACES), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    keyed = reps.select("id", "sig").mapInArrow(run, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    centre = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), F.col("id").alias("c"))).alias("m"))
        .where("n > 1").select("key", F.col("m.c").alias("c"))
    )
    return keyed.join(centre, "key").where("id != c").select("key", "id", "c")


def _close(x, y, r: int):
    """Whether each signature of x differs from each of y in r places at most."""
    import numpy as np

    near = np.empty((len(x), len(y)), bool)
    step = max(1, 2_000_000 // (PLACES * max(1, len(y))))
    for at in range(0, len(x), step):
        near[at : at + step] = np.count_nonzero(x[at : at + step, None, :] != y[None], axis=2) <= r
    return near


def _beyond_centres(r: int):
    """Kernel over the holders of some keys, or of two blocks of one key: role 0 are those beyond the radius from the centre, role 1 whom they meet. Forest of the pairs within the radius."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        key, ids, role, sig = group["key"].to_numpy(), group["id"].to_numpy(), group["role"].to_numpy(), _unpacked(group["sig"])
        by = np.lexsort((role, key))
        edge = [0, *(np.nonzero(np.diff(key[by]))[0] + 1).tolist(), len(by)]
        a, b = [ids[:0]], [ids[:0]]
        for begin, end in zip(edge, edge[1:], strict=False):
            rows = by[begin:end]
            far, all_ = rows[role[rows] == 0], rows[role[rows] == 1]
            near = _close(sig[far], sig[all_], r)
            other = near & (ids[far, None] != ids[None, all_])
            if not other.any():
                continue
            met = other.any(1)
            near, far = near[met], far[met]
            hit = near.any(0)
            near, both = near[:, hit], np.concatenate([far, all_[hit]])
            links = np.zeros((len(both), len(both)), bool)  # a holder that stands in both roles is near itself
            links[: len(far), len(far) :] = near
            links[len(far) :, : len(far)] = near.T
            x, y = forest(links, ids[both])
            a.append(x)
            b.append(y)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _near(reps: DataFrame, r: int, block: int = 1024, bundle: int = 8192) -> DataFrame:
    """Pairs (a, b) within the radius that tie together any two representatives that share a key and lie within the radius.

    Holders near the centre of a key cost one distance each; those beyond it meet all holders of the key, f of n in blocks of `block` by `block`.
    Keys of one block go to tasks of about `bundle` rows."""

    def measured(batches):
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                near = np.count_nonzero(_unpacked(batch.column(2)) != _unpacked(batch.column(3)), axis=1) <= r
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["id", "c", "near"])

    stars = saved(_stars(reps, r), "stars")
    sig, of_centre = reps.select("id", "sig"), reps.select(F.col("id").alias("c"), F.col("sig").alias("c_sig"))
    met = stars.select("id", "c").distinct().join(sig, "id").join(of_centre, "c").select("id", "c", "sig", "c_sig")
    met = saved(met.mapInArrow(measured, "id long, c long, near boolean"), "measured")
    edges = met.where("near").select(F.col("id").alias("a"), F.col("c").alias("b"))
    far = saved(stars.join(met.where("not near").select("id", "c"), ["id", "c"], "left_semi").select("key", "id"), "far")
    count = lambda d, name: d.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    size = saved(count(stars, "n").join(count(far, "f"), "key").where("n > 1"), "sizes")
    total = size.agg(F.sum(F.expr(f"if(n <= {block}, n + f, 0)"))).first()[0] or 0
    size = size.select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("f") / block).cast("int").alias("fb"))
    rows = far.withColumn("role", F.lit(0)).unionByName(stars.select("key", "id").withColumn("role", F.lit(1))).join(size, "key").join(sig, "id")
    rows = rows.withColumn("blk", F.expr("int(pmod(xxhash64(id), if(role = 0, fb, nb)))")).withColumn("other", F.explode(F.expr("sequence(0, if(role = 0, nb, fb) - 1)")))
    rows = rows.withColumns({
        "i": F.expr("if(role = 0, blk, other)"), "j": F.expr("if(role = 0, other, blk)"), "one": F.expr("nb = 1"),
        "dealt": F.expr(f"if(nb = 1, pmod(xxhash64(key), {-(-total // bundle) or 1}), key)"),
    })
    rest = rows.select("one", "dealt", "i", "j", "key", "id", "role", "sig").groupBy("one", "dealt", "i", "j").applyInArrow(_beyond_centres(r), "a long, b long")
    return edges.unionByName(rest)


def _distances(sig, at: int, to: int):
    """Places in which signatures at..to differ from each signature."""
    import numpy as np

    found = np.zeros((to - at, len(sig)), np.uint8)
    for place in range(PLACES):
        found += sig[at:to, place, None] != sig[None, :, place]
    return found


def _common(sets: list, a, b):
    """Intersection sizes of the pairs (a, b) of sorted sets: pair by pair where there are few, else by an incidence product in strips of shingles."""
    import numpy as np

    if len(a) <= 4 * len(sets):
        return np.array([np.isin(sets[x], sets[y], assume_unique=True).sum() for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    n = np.array([len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    keep = times[code] > 1
    code, row = (np.cumsum(times > 1) - 1)[code[keep]], row[keep]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, min(4096, 8_000_000 // len(sets)))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, (at, at + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[lo:hi], code[lo:hi] - at] = 1
        both += x @ x.T
    return both[a, b].astype(np.int64)


def _confirmed(percent: int, r: int):
    """Kernel over one pair of blocks: forest of the links of pairs within the radius, confirmed on full sets."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        ids, blk = group["id"].to_numpy(), group["blk"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(-1, PLACES)
        one = group["i"][0].as_py() == group["j"][0].as_py()
        near = np.zeros((len(ids), len(ids)), bool)
        for at in range(0, len(ids), 128):
            near[at : at + 128] = _distances(sig, at, min(at + 128, len(ids))) <= r
        a, b = np.nonzero(np.triu(near if one else near & (blk[:, None] != blk[None, :]), 1))
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        n = np.array([len(s) for s in sets])
        linked = (100 + percent) * _common(sets, a, b) >= percent * (n[a] + n[b])  # 100 * intersection >= percent * union, in whole numbers
        links = np.zeros_like(near)
        links[a[linked], b[linked]] = links[b[linked], a[linked]] = True
        x, y = forest(links, ids)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block_rows: int = 1024, block_shingles: int = 2_000_000
) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links with 100 * intersection >= percent * union), kept.

    Null or wordless texts have an empty set and link with nothing; equal sets are one class and link at once, whatever
    their number. Repeated ids: each row gets the component of its own set. A null id takes no part: its component is null and it is kept.
    An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    r = radius(percent)
    sigs = saved(signatures(docs, id_col, text_col, k), "signatures")
    classes = sigs.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "sig", "n_shingles")).alias("m"))
    reps = saved(classes.select("digest", "m.id", "m.sig", "m.n_shingles"), "classes")
    group = connected_components(_near(reps, r))
    members = saved(reps.join(group, "id").select("id", "digest", "sig", "component", "n_shingles"), "members")
    blocks = block_pairs(members, F.col("n_shingles"), block_rows, block_shingles)

    def sets(batches):
        memo = WordHashes()
        for batch in batches:
            got = []
            for text, digest in zip(batch.column("text"), batch.column("digest"), strict=True):
                s = shingle_set(text.as_py(), k, memo)
                got.append(s.tobytes() if _digest(s) == digest.as_py() else None)  # null: another text under a repeated id
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # sorted on both sides whatever the sizes: a plan that doesn't turn with the input's size
    full = texts.join(members.select("id", "digest").hint("merge"), "id").select("id", "text", "digest").mapInArrow(sets, "id long, shingles binary").where("shingles is not null")
    links = (
        full.join(blocks.select("id", "sig", "component", "blk", "i", "j"), "id")
        .groupBy("component", "i", "j").applyInArrow(_confirmed(percent, r), "a long, b long")
    )
    linked = connected_components(links)
    of_class = reps.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return sigs.join(of_class, "digest", "left").select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
