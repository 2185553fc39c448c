"""Repeated passages by prefix-partitioned suffix trees over words.

Suffixes start at words. A repeat of `window` words or more is an internal node at that depth or below, so trees are built down to that depth.

1. Prefix plan: occurrences of prefixes of 1, 2, 4 and 8 words are counted over all text in hashed bins, four for each partition, 65 536 a length at the
   most. A suffix belongs to the shortest of its prefixes whose bin is small against a partition, else to
   its whole window: frequent prefixes are split by further words until the parts fit in memory and are even.
2. Every batch of text drops the windows that it holds already (they are repeats whatever happens elsewhere) and deals the others to
   the partitions of their prefixes, as packed columns: path label (64 bits), document, start. A window that a third of all
   documents share thus leaves a batch once, and a partition is sent only the documents that it has leaves of.
3. A partition sorts its leaves by path label; common prefixes of neighbours are the internal nodes of its subtree. Nodes at depth
   `window` are deep: all their leaves but the earliest start a repeat.
4. Starts go back to their documents, where starts that follow one another are joined into maximal repeats; their words are cut out of the whole text.

Path labels are hashes: 16 bits of the path to the inner depth, 48 of the path to `window`. A false repeat needs two windows of one partition to
agree in all 64 bits. As partitions hold about `group` leaves at any size, the chance is group / 2**64 a window: below one in 10**13.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed, saved, slices, small_batches, word_hashes

#: Bins of the prefix plan, at least and at most.
BINS = 4096, 65_536
#: Bytes of text for each word, about.
WORD_BYTES = 6
#: Words of text that are worked on at once.
STEP = 500_000
#: Key of every row where no id stands twice.
ONLY = 0


def _lengths(window: int) -> list[int]:
    return [k for k in (1, 2, 4, 8) if k < window]


def _prefix_hashes(h, lengths: list[int]):
    """Hash of the k words from each position on, for each k; values run over ends of documents and must be masked there."""
    import numpy as np

    def join(a, b, by):
        out = a.copy()
        out[: len(a) - by] = mixed(a[: len(a) - by] * np.uint64(0x9E3779B97F4A7C15) + b[by:])
        return out

    power, k, found = {1: h}, 1, {}
    while 2 * k <= max(lengths):
        power[2 * k] = join(power[k], power[k], k)
        k *= 2
    for length in lengths:
        got, at = None, 0
        for k in sorted(power, reverse=True):
            while at + k <= length:
                got, at = (power[k] if got is None else join(got, power[k], at)), at + k
        found[length] = got
    return found


def _steps(batches: Iterator[pa.RecordBatch], memo: WordHashes, columns: tuple[str, ...] = ()):
    """Documents in groups of about STEP words: (first word of each document and the end, word hashes, values of each of `columns`). A group doesn't
    cross batches. Documents stand in the order of `columns`, and of equal ones the first is taken."""
    import numpy as np

    for whole in batches:
        for batch in slices(whole, "text", 8 * STEP):
            n = batch.num_rows
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            order = np.lexsort(values[::-1]) if columns else np.arange(n)
            if columns:
                differs = np.ones(n, bool)
                differs[1:] = np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)
                order = order[differs]
            text, parts = batch.column("text"), []
            for k in order.tolist():
                t = text[k].as_py()
                parts.append(word_hashes(t.encode("utf-8", "surrogatepass").split() if t else [], memo))
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            yield starts, np.concatenate([np.empty(0, np.uint64), *parts]), *(v[order] for v in values)


def _places(starts, window: int):
    """Positions at which a whole window starts."""
    import numpy as np

    at = np.arange(starts[-1])
    return at[at + window <= np.repeat(starts[1:], np.diff(starts))]


def prefix_plan(texts: DataFrame, window: int, parts: int, bins: int):
    """fits[level, bin]: whether prefixes of that length and bin are rare enough for one of `parts` partitions."""
    import numpy as np

    lengths = _lengths(window)

    def run(batches):
        memo, total, windows = WordHashes(), np.zeros((len(lengths), bins), np.int64), 0
        for starts, h in _steps(batches, memo):
            at = _places(starts, window)
            windows += len(at)
            if len(at) and lengths:
                for level, x in enumerate(_prefix_hashes(h, lengths).values()):
                    total[level] += np.bincount((x[at] % np.uint64(bins)).astype(np.int64), minlength=bins)
        level, own = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(level, -1), pa.int32()), pa.array(np.append(own, 0), pa.int32()), pa.array(np.append(total[level, own], windows))], ["level", "bin", "n"])

    counted = texts.select("text").mapInArrow(run, "level int, bin int, n long").groupBy("level", "bin").agg(F.sum("n").alias("n")).toArrow()  # at most `bins` rows a level
    level, own, n = (counted[c].to_numpy() for c in ("level", "bin", "n"))
    table = np.zeros((len(lengths), bins), np.int64)
    table[level[level >= 0], own[level >= 0]] = n[level >= 0]
    return table <= max(1, int(n[level < 0].sum()) // (4 * parts))


def _packed(values) -> bytes:
    """Numbers as the first of them and the differences of the others, in as many bytes as the largest needs, all low bytes first: mostly equal bytes
    stand together and compress."""
    import numpy as np

    x = np.ascontiguousarray(values).astype(np.int64).view(np.uint64)
    step = np.diff(x)
    wide = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return x[:1].tobytes() + bytes([wide]) + step.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpacked(data: bytes):
    import numpy as np

    if len(data) < 9:
        return np.empty(0, np.int64)
    wide = data[8]
    low = np.frombuffer(data, np.uint8, offset=9).reshape(wide, -1)
    step = np.zeros((low.shape[1] + 1, 8), np.uint8)
    step[1:, :wide] = low.T
    step[0] = np.frombuffer(data, np.uint8, 8)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def _bundles(ids, keys, doc, start, parts: int):
    """Starts of repeats (sorted by document and start) as one row for each bucket of documents: bucket, ids, keys, counts, starts."""
    import numpy as np

    first = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1]).astype(np.int64)
    own, count = doc[first], np.diff(np.append(first, len(doc)))
    bucket = (mixed(ids[own].view(np.uint64) * np.uint64(31) + keys[own].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, count, first, bucket = own[order], count[order], first[order], bucket[order]
    edge = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    columns = [[], [], [], [], []]
    for lo, hi in zip(edge, edge[1:], strict=False):
        columns[0].append(int(bucket[lo]))
        for c, x in zip(columns[1:], (ids[own[lo:hi]], keys[own[lo:hi]], count[lo:hi], np.concatenate([start[f : f + n] for f, n in zip(first[lo:hi], count[lo:hi], strict=True)])), strict=True):
            c.append(_packed(x))
    return [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)]


def _deep_nodes(label):
    """Internal nodes at depth `window` of a subtree whose leaves are sorted by path label: for each leaf the first leaf of its node, and whether the
    node has several."""
    import numpy as np

    joined = np.zeros(len(label), bool)
    joined[1:] = label[1:] == label[:-1]  # the common prefix with the leaf before reaches the depth
    first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(label))))
    return first, joined


_BUCKET = "bucket int, ids binary, keys binary, counts binary, starts binary"
_OURS = ["bucket", "ids", "keys", "counts", "starts"]
_LEAVES = ["part", "docs", "doc_keys", "doc_starts", "labels", "places"]


def repeats(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(id, key, starts, lengths): maximal repeats of each document that has any, packed; every word they cover stands in a window that occurs earlier.

    docs: id, key, text, no nulls in id and key; earlier is by (id, key, start); rows with equal id and key are one document.
    """
    import numpy as np

    lengths = _lengths(window)
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // (WORD_BYTES * group)))
    bins = min(BINS[1], max(BINS[0], 1 << (4 * parts - 1).bit_length()))
    fits = prefix_plan(docs, window, parts, bins)
    inner = max((k for k in (1, 2, 4, 8, 16) if k < window), default=window)

    def deal(batches):
        for starts, h, ids, keys in _steps(batches, WordHashes(), ("id", "key")):
            at = _places(starts, window)
            if not len(at):
                continue
            hashes = _prefix_hashes(h, sorted({*lengths, inner, window}))
            label = hashes[window][at] & np.uint64(0x0000FFFFFFFFFFFF) | hashes[inner][at] & np.uint64(0xFFFF000000000000)
            order = np.argsort(label, kind="stable")
            _, again = _deep_nodes(label[order])
            cut, keep = np.sort(order[again]), np.sort(order[~again])
            if len(cut):
                doc = np.searchsorted(starts, at[cut], "right") - 1
                own = _bundles(ids, keys, doc, at[cut] - starts[doc], parts)
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.int32()), *[pa.nulls(len(own[0]), pa.binary())] * 5], _OURS + _LEAVES)
            place, label = at[keep], label[keep]
            level = np.full(len(keep), len(lengths))
            prefix = hashes[window][place]
            for k in range(len(lengths) - 1, -1, -1):
                x = hashes[lengths[k]][place]
                small = fits[k][(x % np.uint64(bins)).astype(np.int64)]
                level[small], prefix[small] = k, x[small]
            part = (mixed(prefix + level.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            part, place, label = part[by], place[by], label[by]
            doc = np.searchsorted(starts, place, "right") - 1
            edge = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
            columns = [[] for _ in _LEAVES]
            for lo, hi in zip(edge, edge[1:], strict=False):
                used = doc[lo:hi]
                used = used[np.concatenate([[True], used[1:] != used[:-1]])]
                columns[0].append(int(part[lo]))
                for c, x in zip(columns[1:], (_packed(ids[used]), _packed(keys[used]), _packed(starts[used]), label[lo:hi].tobytes(), _packed(place[lo:hi])), strict=True):
                    c.append(x)
            n = len(columns[0])
            leaves = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 4, *leaves], _OURS + _LEAVES)

    def trees(batches):
        """The subtree of one partition. Rows of repeats that are known already pass through."""
        ids, keys, label, leaf_doc, leaf_at, base = [], [], [], [], [], 0
        for batch in batches:
            known = batch.filter(batch.column("part").is_null())
            if known.num_rows:
                yield known.select(_OURS)
            for row in batch.filter(batch.column("part").is_valid()).select(_LEAVES[1:]).to_pylist():
                starts, at = _unpacked(row["doc_starts"]), _unpacked(row["places"])
                doc = np.searchsorted(starts, at, "right") - 1
                ids.append(_unpacked(row["docs"]))
                keys.append(_unpacked(row["doc_keys"]))
                label.append(np.frombuffer(row["labels"], np.uint64))
                leaf_doc.append((doc + base).astype(np.uint32))
                leaf_at.append((at - starts[doc]).astype(np.uint32))
                base += len(starts)
        if not base:
            return
        ids, keys, label = np.concatenate(ids), np.concatenate(keys), np.concatenate(label)
        order = np.lexsort((keys, ids))
        differs = np.zeros(len(ids), bool)
        differs[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        rank = np.empty(len(ids), np.uint64)
        rank[order] = np.cumsum(differs)
        one = order[np.concatenate([[True], differs[1:]])]
        ids, keys = ids[one], keys[one]
        place = (rank[np.concatenate(leaf_doc)] << np.uint64(32)) | np.concatenate(leaf_at).astype(np.uint64)
        del leaf_doc, leaf_at, order, rank
        order = np.lexsort((place, label))
        label, place = label[order], place[order]
        first, joined = _deep_nodes(label)
        again = np.unique(place[joined & (place != place[first])])  # a document dealt by two batches has its leaf twice
        if len(again):
            yield pa.RecordBatch.from_arrays(_bundles(ids, keys, (again >> np.uint64(32)).astype(np.int64), (again & np.uint64(0xFFFFFFFF)).astype(np.int64), parts), _OURS)
        pa.default_memory_pool().release_unused()

    def gathered(batches):
        """Starts of a bucket's documents, those that follow one another joined: one row a document."""
        ids, keys, counts, starts = [], [], [], []
        for batch in batches:
            for row in batch.select(_OURS[1:]).to_pylist():
                for x, c in ((ids, "ids"), (keys, "keys"), (counts, "counts"), (starts, "starts")):
                    x.append(_unpacked(row[c]))
        if not ids:
            return
        ids, keys, counts, at = (np.concatenate(x) for x in (ids, keys, counts, starts))
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((at, keys[doc], ids[doc]))
        doc, at = doc[order], at[order]
        other = np.ones(len(at), bool)
        other[1:] = (ids[doc][1:] != ids[doc][:-1]) | (keys[doc][1:] != keys[doc][:-1])
        begins = other.copy()
        begins[1:] |= at[1:] > at[:-1] + 1
        head = np.nonzero(begins)[0]
        tail = np.append(head[1:], len(at)) - 1
        span, length = at[head], at[tail] - at[head] + window
        edge = np.append(np.nonzero(other[head])[0], len(head))
        own = doc[head[edge[:-1]]]
        spans = [[_packed(x[lo:hi]) for lo, hi in zip(edge, edge[1:], strict=False)] for x in (span, length)]
        table = pa.table([pa.array(ids[own]), pa.array(keys[own]), *(pa.array(x, pa.binary()) for x in spans)], ["id", "key", "starts", "lengths"])
        yield from table.to_batches(max_chunksize=2000)

    dealt = small_batches(docs).mapInArrow(deal, f"{_BUCKET}, part int, docs binary, doc_keys binary, doc_starts binary, labels binary, places binary")
    found = dealt.repartitionById(parts, F.coalesce("part", "bucket")).mapInArrow(trees, _BUCKET)
    return found.repartitionById(parts, F.col("bucket")).mapInArrow(gathered, "id long, key long, starts binary, lengths binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id (null: the largest) and __key (a hash of the text where ids repeat; it need not travel where none does)."""
    once = docs.groupBy(F.col(id_col).cast("long").alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    key = F.lit(ONLY).cast("long") if once else F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(ONLY))
    return docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), "__key": key})


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group: int = 1_000_000) -> DataFrame:
    """(id, start, length) in words: the passages of each document whose every window of `window` words starts earlier too, as long as they reach. Null ids and repeated rows as in cut_repeats."""
    plain = _keyed(docs.select(id_col, text_col), id_col, text_col).select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col(text_col).cast("string").alias("text"))

    def rows(batches):
        import numpy as np

        for batch in batches:
            starts, lengths = ([_unpacked(x.as_py()) for x in batch.column(c)] for c in ("starts", "lengths"))
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in starts])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lengths))], ["id", "start", "length"])

    found = repeats(plain, window, group).mapInArrow(rows, "id long, start long, length long")
    return found.withColumn("id", F.nullif("id", F.lit(2**63 - 1)))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group: int = 1_000_000) -> DataFrame:
    """docs with n_words, n_removed and kept_text: every word goes that a window of `window` words covers whose word sequence also
    starts earlier (smaller id, or same document and earlier start). Windows are judged on the input.

    Words part at space and \\t \\n \\v \\f \\r and are compared unchanged. A null text has no words; kept_text is then empty. Documents
    shorter than the window keep all. A null id counts as larger than any other. Repeated rows with one id and text are one document;
    rows with one id and different texts are ordered by a hash of the text. An empty table gives an empty result. Input columns
    named n_words, n_removed or kept_text are replaced.
    """
    keyed = _keyed(docs.drop("n_words", "n_removed", "kept_text"), id_col, text_col)
    plain = keyed.select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = saved(repeats(plain, window, group), "repeats")
    # sorted on both sides whatever the sizes: a plan that doesn't turn with the input's size
    of_doc = found.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("starts").alias("__starts"), F.col("lengths").alias("__lengths")).hint("merge")
    schema = T.StructType([*(f for f in keyed.schema if f.name not in ("__id", "__key")), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                total, removed, kept = [], [], []
                for text, starts, lengths in zip(batch.column(text_col), batch.column("__starts"), batch.column("__lengths"), strict=True):
                    t = text.as_py()
                    words = t.encode("utf-8", "surrogatepass").split() if t else []
                    stay, at = [], 0
                    if got := starts.as_py():
                        for s, n in zip(_unpacked(got).tolist(), _unpacked(lengths.as_py()).tolist(), strict=True):
                            stay += words[at:s]
                            at = max(at, s + n)
                    stay += words[at:]
                    total.append(len(words))
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay))
                cols = [batch.column(f.name) for f in schema.fields[:-3]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.fieldNames())

    return keyed.join(of_doc, ["__id", "__key"], "left").drop("__id", "__key").mapInArrow(cut, schema)
