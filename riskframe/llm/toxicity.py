"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; other text is unlabelled, not negative. With the class prior p, the risk of a classifier g under
loss l is estimated from both by p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]); where the second part falls below zero, its gradient is
reversed, which keeps a flexible model from calling all unlabelled text clean. Linear classifiers over the presence of words are
trained with numpy on bounded samples of the labelled documents, the population that p is the share of; the unlabelled sample's own labels
stay unread. Scale and threshold come from the same risk. Candidate words come from the sampled documents; those that count are
chosen by their frequencies over all documents outside the held-out fold, and every document is scored in full.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, small_batches

#: Letters A-Z become a-z and every other ASCII character parts words, so marks stuck to a word don't hide it. Bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold whose labels are never read: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Features are words and their beginnings of 5, 6 and 7 bytes (languages that glue words show their stems there), hashed to so many places.
PLACES = 2**20
STEMS = (5, 6, 7)
#: Places that are counted over all documents, by default.
CANDIDATES = 16_384


class Features(dict):
    """word -> places of its features, remembered up to a bound; only those of `wanted` (all, if None)."""

    LIMIT = 200_000

    def __init__(self, wanted=None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        places = {xxhash.xxh3_64_intdigest(word) % PLACES, *(xxhash.xxh3_64_intdigest(word[:n], 1) % PLACES for n in STEMS if len(word) >= n)}
        self[word] = got = tuple(x for x in places if self.wanted is None or x in self.wanted)
        return got

    def of(self, text: str | None) -> set[int]:
        words = set(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) if text else ()
        return {x for w in words for x in self[w]}


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list:
    """Features (sorted uint32) of the documents in ids (bounded)."""

    def run(batches):
        import numpy as np

        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(sorted(features.of(t.as_py())), "<u4").tobytes() for t in batch.column(0)], pa.binary())], ["places"])

    import numpy as np

    picked = docs.join(F.broadcast(ids), docs[id_col].cast("long") == ids["__id"], "left_semi").select(F.col(text_col).cast("string"))
    return [np.frombuffer(r.places, "<u4") for r in picked.mapInArrow(run, "places binary").collect()]


def _surest(x, n: int, y, m: int, seen, size: int):
    """Places whose shares x / n and y / m differ most surely, sorted; none that fewer than 5 documents hold."""
    import numpy as np

    known = np.nonzero(seen >= 5)[0]
    p, q = (x[known] + 0.5) / (n + 1), (y[known] + 0.5) / (m + 1)
    z = np.abs(p - q) / np.sqrt(p * (1 - np.minimum(p, 0.99)) / (n + 1) + q * (1 - np.minimum(q, 0.99)) / (m + 1))
    top = np.lexsort((known, -z))[:size]
    return np.sort(known[top[z[top] > 0]])


def _held(rows: list):
    """How many of the sampled documents hold each place."""
    import numpy as np

    held = np.zeros(PLACES, np.int64)
    for own in rows:  # a document holds a place once
        held[own] += 1
    return held


def _frequencies(docs: DataFrame, text_col: str, candidates):
    """Number of documents, and how many of them hold each candidate place, over all of docs. A task sends one row a candidate."""
    wanted = frozenset(candidates.tolist())

    def run(batches):
        import numpy as np

        features, n, held = Features(wanted), 0, np.zeros(PLACES, np.int64)
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0):
                held[list(features.of(t.as_py()))] += 1
        own = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(held[own], n))], ["place", "n"])

    import numpy as np

    total = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, count = total["place"].to_numpy(), total["n"].to_numpy()
    held = np.zeros(PLACES, np.int64)
    held[place[place >= 0]] = count[place >= 0]
    return int(count[place < 0].sum()), held


def _chosen(pos: list, other: list, docs: DataFrame, text_col: str, size: int, most: int):
    """Places whose share of documents differs most surely between the positives and all documents. Candidates come from the sampled documents, their frequencies
    from all."""
    import numpy as np

    a, b = _held(pos), _held(other)
    candidates = _surest(a, len(pos), b, len(other), a + b, most)
    n, held = _frequencies(docs, text_col, candidates)
    seen = np.zeros(PLACES, np.int64)
    seen[candidates] = (a + held)[candidates]
    return _surest(a, len(pos), held, n, seen, size)


def _matrix(rows: list, places):
    import numpy as np

    x = np.zeros((len(rows), len(places)), np.uint8)
    for k, own in enumerate(rows):
        x[k, np.searchsorted(places, np.intersect1d(places, own))] = 1
    return x


def _refit(gp, gu, prior: float, gn=None, ridge: float = 1e-5) -> tuple[float, float]:
    """(scale, shift) of the logits that undo what decay shrank, by Newton steps on a convex risk: that of positives and unlabelled text corrected by the prior,
    p E+[l(g) - l(-g)] + Eu[l(-g)]; or, where the logits gn of labelled negatives are given, the supervised one."""
    import numpy as np

    other, weight = (gu, 1.0) if gn is None else (gn, 1 - prior)
    x = np.stack([np.concatenate([gp, other]), np.ones(len(gp) + len(other))], 1)
    share = np.repeat([prior / len(gp), weight / len(other)], [len(gp), len(other)])
    lift = prior * np.stack([gp, np.ones(len(gp))], 1).mean(0)  # of positives: l(z) - l(-z) = -z, and l(z) = l(-z) - z
    if gn is None:
        share[: len(gp)] = 0.0
    w = np.array([1.0, 0.0])
    risk = lambda w: share @ np.logaddexp(0, x @ w) - lift @ w + ridge * (w[0] - 1) ** 2
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * s) - lift + [2 * ridge * (w[0] - 1), 0]
        step = np.linalg.solve((x * (share * s * (1 - s))[:, None]).T @ x + np.diag([2 * ridge, 1e-9]), grad)
        t = 1.0
        while t > 1e-6 and risk(w - t * step) > risk(w):
            t /= 2
        if t <= 1e-6 or np.abs(step).max() < 1e-9:
            break
        w = w - t * step
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(pos: list, unl: list, prior: float, places, neg: list | None = None, members: int = 3, epochs: int = 40, rate: float = 0.02, decay: float = 1e-3) -> tuple[dict[int, float], float]:
    """(weight of each of `places`, bias): mean of `members` linear classifiers under the non-negative risk, trained by Adam,
    with its scale and bias refitted under the prior-corrected risk, or on labelled negatives `neg` where they are given."""
    import math

    import numpy as np

    prior = min(max(prior, 1e-4), 0.9)
    base = math.log(prior / (1 - prior))
    if not pos or not unl:
        return {}, base
    xp, xu = _matrix(pos, places), _matrix(unl, places)
    total, bias_total = np.zeros(len(places)), 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for member in range(members):
        rng = np.random.default_rng(member)
        w, m, v = np.zeros(len(places) + 1), np.zeros(len(places) + 1), np.zeros(len(places) + 1)
        w[-1] = base
        steps, t = max(1, min(len(xp), len(xu)) // 128), 0
        for _ in range(epochs):
            for p_rows, u_rows in zip(np.array_split(rng.permutation(len(xp)), steps), np.array_split(rng.permutation(len(xu)), steps), strict=True):
                bp, bu = xp[p_rows].astype(np.float32), xu[u_rows].astype(np.float32)
                gp, gu = bp @ w[:-1] + w[-1], bu @ w[:-1] + w[-1]
                # logistic loss l(z) = log(1 + exp(-z)); the derivative of l(g) is s(g) - 1, that of l(-g) is s(g)
                sp, su = sigmoid(gp), sigmoid(gu)
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                if negative >= 0:
                    dp, du = prior * (sp - 1) / len(gp) - prior * sp / len(gp), su / len(gu)
                else:
                    dp, du = prior * sp / len(gp), -su / len(gu)
                grad = np.concatenate([dp @ bp + du @ bu, [dp.sum() + du.sum()]])
                grad[:-1] += decay * w[:-1]
                t += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        total += w[:-1]
        bias_total += float(w[-1])
    w, bias = total / members, bias_total / members
    scale, shift = _refit(xp @ w + bias, xu @ w + bias, prior, _matrix(neg, places) @ w + bias if neg else None)
    w, bias = scale * w, scale * bias + shift
    return {int(p): float(x) for p, x in zip(places, w, strict=True)}, bias


def toxicity_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 8000, features: int = 512, candidates: int = CANDIDATES, supervised: bool = False,
) -> tuple[dict[int, float], float]:
    """(weight of each place, bias) of the classifier; see toxicity. Without labels of both kinds there are no weights, and the bias gives a score of 0.05."""
    import math

    marked = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max("y").alias("y"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    pos_ids = first_by_hash(marked.where("y = 1").select("__id"), "__id", max_positive)
    unl_ids = first_by_hash(marked.select("__id"), "__id", max_unlabelled)
    if not n or not 0 < toxic < n:
        return {}, math.log(0.05 / 0.95)
    pos, unl = (_sample(docs, ids, id_col, text_col) for ids in (pos_ids, unl_ids))
    neg = _sample(docs, first_by_hash(marked.where("y = 0").select("__id"), "__id", max_unlabelled), id_col, text_col) if supervised else None
    return train(pos, unl, toxic / n, _chosen(pos, unl, docs.where(~held_out(id_col)), text_col, features, candidates), neg)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = 4000, max_unlabelled: int = 8000, features: int = 512, candidates: int = CANDIDATES, supervised: bool = False,
) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Labels are read only outside the held-out fold (an id of null counts as held out). The class prior is the toxic share of all
    labels read. At most max_positive toxic and max_unlabelled labelled documents of any kind, the first by a hash of the id, are trained on;
    at most `candidates` hashed words of theirs are counted over all documents outside the held-out fold, and `features` of them chosen by that. Scale and threshold minimise the same prior-corrected risk; with
    `supervised` they are fitted on as many labelled negatives instead. Every document is scored by its whole text, so the share of documents called
    toxic may be any, and a null or empty text gets the score of no words. Where the labels are all of one kind or none, all scores are 0.05. An id with several labels is toxic if one of them is. Repeated rows get equal scores; input columns of the three
    names are replaced. An empty table gives an empty result.
    """
    docs = small_batches(docs)
    weight, bias = toxicity_model(docs, labels, id_col, text_col, label_col, max_positive, max_unlabelled, features, candidates, supervised)
    kept = docs.drop("held_out", "score", "predicted")
    names = [*kept.columns, "score"]
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        import math

        features = Features(weight.keys())
        for batch in batches:
            z = [bias + math.fsum([weight[x] for x in features.of(t.as_py())]) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], pa.float64())], names)

    scored = kept.mapInArrow(run, schema)
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})
