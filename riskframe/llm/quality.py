"""Quality by non-negative positive-unlabelled learning with an estimated class prior.

Trusted positives are documents marked good; all other text is unlabelled, never negative: labels of bad documents aren't read at all.

1. Every whole text becomes a few statistics of its shape (case, marks per word, lengths, repeats), each a level from 0 to LEVELS. They are written once, a score of bytes a document.
2. A plain classifier of positives against unlabelled text orders documents. Among those above a score c, the unlabelled share over the positives' share is at least the class prior, and equals it
   where no bad document scores that high; the prior is the ratio at the c whose upper confidence bound is smallest. Classifiers are trained on one half of the documents (by a hash) and both shares
   counted over the whole other half, since a classifier flatters the positives that it was trained on.
3. With prior p, a linear classifier g is trained in numpy on bounded samples under the risk p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]). Where the second part falls below zero its gradient
   is reversed.
4. The threshold minimises the same risk for errors instead of losses, p P+(g < t) + max(0, Pu(g >= t) - p P+(g >= t)), again over the whole other half.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, saved, slices, small_batches

LEVELS = 24
#: Bins of scores from -SPAN to SPAN.
BINS, SPAN = 4096, 30.0

#: Bytes whose number per word is a statistic.
MARKS = [b".", b",", b"!?", b"|", b"#$%&*@^~=+<>_\\", b"\"'`", b"()[]{}", b":;", b"-/", b"0123456789", b"\n"]
_UPPER, _LOWER, _SPACE = bytes(range(65, 91)), bytes(range(97, 123)), b" \t\n\v\f\r"
_BEYOND = bytes(range(128, 256))
STATISTICS = len(MARKS) + 7


def _level(x: float) -> int:
    """Shares as levels, finer near 0; ratios over 1 count as 1."""
    return int(LEVELS * math.sqrt(min(1.0, x)))


def shape(text: str | None) -> bytes:
    """The levels of a text's statistics, one byte each; all 0 for a null or empty one."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    words = b.split()
    if not words:
        return bytes(STATISTICS)
    n, w = len(b), len(words)
    count = lambda marks: n - len(b.translate(None, marks))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in b.split(b"\n") if x]
    rates = [_level(count(m) / w) for m in MARKS]
    rates += [
        _level(upper / max(1, upper + lower)), _level(count(_BEYOND) / n), _level(1 - len(set(lines)) / max(1, len(lines))), _level(len(set(words)) / w),
        min(LEVELS, int(1.2 * (n - count(_SPACE)) / w)), min(LEVELS, int(1.2 * math.log2(1 + w))), min(LEVELS, int(2 * math.log2(1 + n / max(1, len(lines))))),
    ]
    return bytes(rates)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold whose labels are never read: crc32 of the id as text leaves 1 on division by 3; a null id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _bits(codes):
    """(n, STATISTICS * LEVELS) of 0 and 1: whether each statistic reaches each level."""
    import numpy as np

    return (codes[:, :, None] > np.arange(LEVELS, dtype=np.uint8)).reshape(len(codes), -1).astype(np.float32)


def _codes(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, STATISTICS)


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(pos, unl, gradients, epochs: int, rate: float, decay: float):
    """Weights and bias after batches of both samples; gradients(gp, gu) gives the risk's derivatives at the scores of a batch."""
    import numpy as np

    rng = np.random.default_rng(0)
    w, m, v = (np.zeros(pos.shape[1] + 1) for _ in range(3))
    least, t = min(len(pos), len(unl)), 0
    steps = max(min(8, least), least // 256)
    for _ in range(epochs):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(len(pos)), steps), np.array_split(rng.permutation(len(unl)), steps), strict=True):
            bp, bu = pos[p_rows], unl[u_rows]
            dp, du = gradients(bp @ w[:-1] + w[-1], bu @ w[:-1] + w[-1])
            grad = np.concatenate([dp @ bp + du @ bu, [dp.sum() + du.sum()]])
            grad[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_plain(pos, unl, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3):
    """Positives against unlabelled text, both of equal weight."""

    def gradients(gp, gu):
        return (_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)

    return _adam(_bits(pos), _bits(unl), gradients, epochs, rate, decay)


def fit_nnpu(pos, unl, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-3):
    """The non-negative risk under the logistic loss l(z) = log(1 + exp(-z))."""
    import numpy as np

    def gradients(gp, gu):
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if np.logaddexp(0, gu).mean() >= prior * np.logaddexp(0, gp).mean():
            return prior * (sp - 1 - sp) / len(gp), su / len(gu)
        return prior * sp / len(gp), -su / len(gu)

    return _adam(_bits(pos), _bits(unl), gradients, epochs, rate, decay)


def class_prior(positive, every, delta: float = 0.1) -> float:
    """The share of positives, from counts by score bin (ascending) of the positives and of all documents: the ratio of the tails at the bin whose upper bound is smallest."""
    import numpy as np

    n, m = int(positive.sum()), int(every.sum())
    if not n or not m:
        return 0.5
    p, u = positive[::-1].cumsum() / n, every[::-1].cumsum() / m
    slack = math.sqrt(math.log(4 / delta) / 2)
    good = np.nonzero(p > 0)[0]
    bound = (u[good] + slack / math.sqrt(m) + slack / math.sqrt(n)) / p[good]
    best = good[int(bound.argmin())]
    return float(min(0.999, max(0.001, u[best] / p[best])))


def risk_threshold(positive, every, prior: float) -> int:
    """The first bin that counts as good: the prior-corrected error is least there. Of equally good ones the middle of the first run is taken."""
    import numpy as np

    n, m = max(1, int(positive.sum())), max(1, int(every.sum()))
    below = np.concatenate([[0], positive.cumsum()]) / n
    above = (m - np.concatenate([[0], every.cumsum()])) / m
    risk = prior * below + np.maximum(0.0, above - prior * (1 - below))
    first = int(risk.argmin())
    last = first
    while last + 1 < len(risk) and risk[last + 1] <= risk[first] + 1e-12:
        last += 1
    return (first + last) // 2


def _bin(z):
    import numpy as np

    return np.clip((z + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)


def _histograms(codes: DataFrame, w):
    """Counts by score bin of the positives and of all documents. codes: codes, positive. A task sends a row for each bin it has met."""
    import numpy as np

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            at = _bin(_bits(_codes(batch.column("codes"))) @ w[:-1] + w[-1]) if batch.num_rows else np.empty(0, np.int64)
            mark = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(at[mark], minlength=BINS)
            total[1] += np.bincount(at, minlength=BINS)
        own = np.nonzero(total[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[0, own]), pa.array(total[1, own])], ["bin", "p", "n"])

    got = codes.select("codes", "positive").mapInArrow(run, "bin long, p long, n long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toArrow()  # BINS rows at most
    out = np.zeros((2, BINS), np.int64)
    out[0, got["bin"].to_numpy()], out[1, got["bin"].to_numpy()] = got["p"].to_numpy(), got["n"].to_numpy()
    return out[0], out[1]


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 8000, max_unlabelled: int = 16_000):
    """(weights with the bias at the end, prior): see quality. None without positives."""
    import numpy as np

    def shapes(batches):
        for whole in batches:
            for batch in slices(whole, "t"):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shape(t.as_py()) for t in batch.column("t")], pa.binary())], ["id", "codes"])

    every = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(shapes, "id long, codes binary")
    marks = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(F.col(label_col).cast("int")) == 1).alias("positive"))
    half = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)), F.lit(0)) == 0
    codes = saved(every.join(marks.where("positive"), "id", "left").withColumns({"positive": F.coalesce("positive", F.lit(False)), "train": half}), "shapes")
    train, count = codes.where("train"), codes.where("not train")

    def sample(rows: DataFrame, bound: int):
        few = first_by_hash(rows.select("id", "codes").withColumn("__key", F.concat(F.coalesce(F.col("id"), F.lit(0)).cast("string").cast("binary"), F.col("codes"))), "__key", bound)
        return np.frombuffer(b"".join(sorted(bytes(r.codes) for r in few.select("codes").collect())), np.uint8).reshape(-1, STATISTICS)

    pos, unl = sample(train.where("positive"), max_positive), sample(train, max_unlabelled)
    if not len(pos):
        return None
    prior = class_prior(*_histograms(count, fit_plain(pos, unl)))
    w = fit_nnpu(pos, unl, prior)
    at = risk_threshold(*_histograms(count, w), prior)
    w[-1] -= at * (2 * SPAN / BINS) - SPAN
    return w, prior


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 8000, max_unlabelled: int = 16_000) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Labels are read only outside the held-out fold, and of them only which documents are good; an id with several labels is good if all of them say so. At most max_positive good and
    max_unlabelled documents of any kind, the first by a hash, of one half are trained on. The class prior and the threshold come from all documents of the other half. Every document is scored by its whole
    text, and a null or empty text gets the score of no words. Without good documents in the first half all scores are 0.5. Repeated rows get equal scores; input columns of the three names are replaced. An empty
    table gives an empty result.
    """
    docs = small_batches(docs)
    model = quality_model(docs, labels, id_col, text_col, label_col, max_positive, max_unlabelled)
    kept = docs.drop("held_out", "score", "predicted")
    names, schema = [*kept.columns, "score"], kept.withColumn("score", F.lit(0.0)).schema
    w = None if model is None else model[0]

    def run(batches):
        import numpy as np

        for whole in batches:
            for batch in slices(whole, text_col):
                score = np.full(batch.num_rows, 0.5)
                if w is not None and batch.num_rows:
                    codes = np.frombuffer(b"".join(shape(t.as_py()) for t in batch.column(text_col)), np.uint8).reshape(-1, STATISTICS)
                    score = _sigmoid(_bits(codes) @ w[:-1] + w[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names)

    scored = kept.mapInArrow(run, schema)
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})
