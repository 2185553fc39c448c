"""Periodic runs of words by enumeration of maximal pairs.

A maximal pair are two places i < j whose word sequences agree for exactly l words and whose left words differ (or i has none). Then the l + q words from i on, q = j - i, have
period q and no neighbour extends them: pairs with l >= 2 q and l + q >= `least` are exactly the runs, and nothing has to be extended word by word. Of the multiples of a period that
give one stretch, the smallest is its period.

1. Over a batch of texts, every sequence of `shallow` words (the least l that a pair may have) is hashed; documents in which none stands twice have no run. That is decided on all words.
2. In the others, suffixes are sorted by doubling of ranks, and the common prefixes of neighbours are read off the ranks of each doubling. Suffixes whose first `shallow` words stand only
   once hang above every node that counts and are left out.
3. LCP intervals are closed bottom-up on a stack. An interval keeps its leaves sorted by place, and in lists by the word to their left. When two children meet, each leaf of
   the smaller one looks for partners within reach (half of the interval's depth) in the lists of other left words. Places of one sequence that lie so close follow each other at its period, so
   those within reach are of two classes: the first one's, and one that all others share.

The work is n log n words for any text, a single word repeated throughout included.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed, slices, small_batches, word_hashes

#: Words that are worked on at once.
STEP = 250_000


def repeated_windows(h, starts, k: int):
    """For each place, whether its k words stand at another place of the same document too (by hash: never missed, rarely wrong). h: word hashes of
    the documents that begin at starts, with the end."""
    import numpy as np

    n = len(h)
    found = np.zeros(n, bool)
    size = np.diff(starts)
    places = np.nonzero(np.arange(n) + k <= np.repeat(starts[1:], size))[0]
    if not len(places):
        return found
    power, done, got = h.copy(), 1, None
    at = 0
    while done <= k:  # windows of 1, 2, 4, ... words, joined as k is written in binary
        if k & done:
            got = power.copy() if got is None else _joined(got, power, at)
            at += done
        power, done = _joined(power, power, done), done * 2
    key = mixed(got[places] + np.repeat(np.arange(len(size), dtype=np.uint64), size)[places] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(places), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    found[places[twice]] = True
    return found


def _joined(a, b, by: int):
    import numpy as np

    out = a.copy()
    if by < len(a):
        out[: len(a) - by] = mixed(a[: len(a) - by] * np.uint64(0x9E3779B97F4A7C15) + b[by:])
    return out


def suffixes(ids, chosen):
    """(order, lcp): the chosen suffixes of a sequence sorted by their words, and the words each has in common with the one before it (0 for the first).

    A suffix's rank is the number of suffixes before its group. Each doubling splits only groups of several; a suffix that ends inside a window is in no group with another.
    """
    import numpy as np

    n = len(ids)
    levels = []
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    begins = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    open_ = order[~(begins & np.append(begins[1:], True))]
    k = 1
    while True:
        levels.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        if not len(open_):
            break
        after = np.where(open_ + k < n, rank[np.minimum(open_ + k, n - 1)] + 1, 0)
        own = rank[open_]
        by = np.lexsort((after, own))
        open_, own, after = open_[by], own[by], after[by]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        begins = group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(open_))
        first, part = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(begins, at, 0))
        rank = rank.copy()
        rank[open_] = own + part - first
        open_ = open_[~(begins & np.append(begins[1:], True))]
        k *= 2
    order = chosen[np.argsort(rank[chosen])]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for j in range(len(levels) - 1, -1, -1):
        level, k = levels[j], 1 << j
        inside = (a + k <= n) & (b + k <= n)
        same = inside & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        step = np.where(same, k, 0)
        lcp[1:] += step
        a += step
        b += step
    return order, lcp


class _Interval:
    """Leaves of an LCP interval: all places in order, and the places of each left word in order."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def _merged(a: list, b: list) -> list:
    """The sorted list of both; b is the shorter one and a may be changed."""
    if len(b) * 8 < len(a):
        for x in b:
            insort(a, x)
        return a
    a += b
    a.sort()
    return a


def maximal_pairs(order: list, lcp: list, left: list, shallow: int, least: int):
    """(i, l, q) of maximal pairs with l >= 2 q and l + q >= least. order and lcp as of suffixes(); left: the word before each place."""
    pairs = []

    def met(a: _Interval, b: _Interval, depth: int) -> _Interval:
        if len(b.places) > len(a.places):
            a, b = b, a
        reach, near = depth // 2, least - depth
        for c, own in b.classes.items():
            for u in own:
                lo, hi = bisect_left(a.places, u - reach), bisect_right(a.places, u + reach)
                if lo == hi:
                    continue
                for d in {left[a.places[lo]], left[a.places[hi - 1]]} - {c}:
                    other = a.classes[d]
                    for v in other[bisect_left(other, u - reach) : bisect_right(other, u + reach)]:
                        if (q := abs(u - v)) >= near:
                            pairs.append((min(u, v), depth, q))
        a.places = _merged(a.places, b.places)
        for c, own in b.classes.items():
            a.classes[c] = _merged(a.classes[c], own) if c in a.classes else own
        return a

    stack: list[tuple[int, _Interval]] = []
    last: _Interval | None = None
    for place, depth in zip(order, lcp, strict=True):
        if depth < shallow:
            depth = 0
        while stack and stack[-1][0] > depth:
            at, node = stack.pop()
            last = met(node, last, at)
        if not depth:
            stack.clear()
        elif stack and stack[-1][0] == depth:
            stack[-1] = (depth, met(stack[-1][1], last, depth))
        elif last is not None:
            stack.append((depth, last))
        last = _Interval(place, left[place])
    while stack:
        at, node = stack.pop()
        last = met(node, last, at)
    return pairs


def runs_of(ids, chosen, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers, by start, then period. chosen: places whose first words stand twice, in order."""
    import numpy as np

    order, lcp = suffixes(ids, chosen)
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    found: dict[tuple[int, int], int] = {}
    for i, depth, q in maximal_pairs(order.tolist(), lcp.tolist(), left, _shallow(least), least):
        key = (i, depth + q)
        found[key] = min(q, found.get(key, q))
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def _shallow(least: int) -> int:
    """The fewest words that the places of a pair agree in: l >= 2 q and l + q >= least."""
    return max(2, -(-2 * least // 3))


def planted(n: int, h: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on repeat the p words at a, by the hash of the id; None if the text stays as it is."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, plant: bool = False) -> DataFrame:
    """docs with n_words, runs (list of start, length, period; by start, then period) and collapsed (kept words joined by a space).

    A run is a stretch of consecutive words with smallest period q and length >= max(least, 3 q) that no neighbouring word extends keeping period q. A word is dropped if a run
    contains it after the run's first q words. Words part at space and \\t \\n \\v \\f \\r and are compared unchanged. A null or empty text has no words, no runs and an empty
    collapsed text. Each row stands alone: repeated rows get equal results, and an empty table gives an empty one. Of input columns named n_words, runs or collapsed the new ones take the place.
    With `plant`, the words of every tenth document (by crc32 of its id; none of a null id) are first made periodic from some place on.

    A text is worked on whole in one task, in memory of some hundred bytes a word where it has repeats.
    """
    kept = docs.drop("n_words", "runs", "collapsed", "__h")
    keyed = small_batches(kept).withColumn("__h", F.crc32(F.col(id_col).cast("string").cast("binary")) if plant else F.lit(None).cast("long"))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    names, plain = schema.fieldNames(), kept.columns

    def run(batches):
        import numpy as np

        memo, shallow = WordHashes(), _shallow(least)
        run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for whole in batches:
            for batch in slices(whole, text_col, 6 * STEP):
                words, hashes = [], []
                for text, h in zip(batch.column(text_col).cast(pa.binary()), batch.column("__h"), strict=True):
                    own = text.as_py().split() if text.is_valid else []
                    own_hash = word_hashes(own, memo)
                    if h.is_valid and (change := planted(len(own), h.as_py())):
                        a, p = change
                        at = np.arange(len(own))
                        at[a:] = a + (at[a:] - a) % p
                        own, own_hash = [own[k] for k in at.tolist()], own_hash[at]
                    words.append(own)
                    hashes.append(own_hash)
                starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                again = repeated_windows(np.concatenate([np.empty(0, np.uint64), *hashes]), starts, shallow)
                runs, collapsed = [], []
                for k, own in enumerate(words):
                    chosen = np.nonzero(again[starts[k] : starts[k + 1]])[0]
                    found = []
                    if len(chosen):
                        number: dict[bytes, int] = {}  # words are compared, not their hashes
                        found = runs_of(np.array([number.setdefault(w, len(number)) for w in own], np.int64), chosen, least)
                    if found:
                        stay = np.ones(len(own), bool)
                        for start, length, period in found:
                            stay[start + period : start + length] = False
                        own = [own[x] for x in np.nonzero(stay)[0].tolist()]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    collapsed.append(b" ".join(own))
                columns = [batch.column(n) for n in plain]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(w) for w in words], pa.int64()), pa.array(runs, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())], names)

    return keyed.mapInArrow(run, schema)
