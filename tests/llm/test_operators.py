"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta", "eta,", "theta", "iota", "kappa"]
    base = [" ".join(rnd.choice(vocab) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(5, 120))) for _ in range(n // 3)]
    out = []
    for k in range(n):
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 8])):
            t[rnd.randrange(len(t))] = f"w{rnd.randint(0, 9999)}"
        out.append(rnd.choice([" ", "\n", "\t "]).join(t))
    passage = " ".join(f"p{k}" for k in range(70))
    out += [f"{out[0]} {passage}", f"x {passage} y", None, "", "  \n ", "one", "One", "two words", out[3], out[3], "long " * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], [None, "a", "b", "ä", "hot", "hot"][k % 6], len(t or "")) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


def test_components_of_chains_and_stars(spark):
    from riskframe.llm.common import connected_components

    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 50)] + [(7, 7), (9, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs):
    from riskframe.llm.minhash_dedup import near_duplicates

    got = {r.id: r for r in near_duplicates(docs, k=3, percent=85, block_rows=8).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert links and {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_edges(spark, docs):
    from riskframe.llm.minhash_dedup import near_duplicates

    assert near_duplicates(docs.limit(0)).count() == 0
    same = docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3000).cast("long")))).withColumn("sig", F.lit("clash"))
    assert near_duplicates(same).groupBy("component_id").count().collect() == [(1, 3000)]  # a group of exact copies
    odd = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (2, None, 4)], "doc_id long, text string, component_id long")
    got = sorted(((r.id, r.component_id, r.kept) for r in near_duplicates(odd).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]


def test_chunk_keys_keep_the_guarantee():
    from riskframe.llm.minhash_dedup import PLACES, chunk_keys, radius

    rng = np.random.default_rng(0)
    r = radius(85)
    for _ in range(200):
        a = rng.integers(0, 65536, PLACES, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(PLACES, r, replace=False)
        b[at] ^= 1
        keys = chunk_keys(np.stack([a, b]), r)
        assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("block", (4, 1024))
def test_candidates_among_the_holders_of_a_key(spark, block):
    """Signatures that share a quarter of their places with all others make no group; those within the radius that share a key are tied together, whatever the blocks."""
    from riskframe.llm.minhash_dedup import PLACES, _near, chunk_keys, radius

    rng, r = np.random.default_rng(8), radius(85)
    common = rng.integers(0, 2**16, PLACES, dtype=np.uint16)
    base = np.where(rng.random((250, PLACES)) < 0.5, common, rng.integers(0, 2**16, (250, PLACES), dtype=np.uint16))
    parent = rng.integers(0, 250, 150)
    copy = base[parent].copy()
    for row in copy:
        row[rng.choice(PLACES, rng.integers(1, r + 8), replace=False)] = rng.integers(0, 2**16)
    sig = np.concatenate([base, copy]).astype("<u2")
    reps = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sig)], "id long, sig binary")
    got = {(r_.a, r_.b) for r_ in _near(reps, r, block=block, bundle=64).collect() if r_.a != r_.b}

    def reach(pairs):
        root = list(range(len(sig)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if z in (x, y) else z for z in root]
        return root

    keys = [set(k) for k in chunk_keys(sig, r).tolist()]
    within = [(a, b) for a in range(len(sig)) for b in range(a) if (sig[a] != sig[b]).sum() <= r and keys[a] & keys[b]]
    met = sum(bool(keys[a] & keys[b]) for a in range(len(sig)) for b in range(a))
    assert 100 < len(within) < met / 2  # many share keys and lie beyond the radius
    assert reach(got) == reach(within)


def test_near_vectors(spark):
    from riskframe.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    v = np.concatenate([base[rng.integers(0, 30, 200)] + rng.standard_normal((200, 16)) * 0.12, base[:1].repeat(150, 0), base[:1] + rng.standard_normal((150, 16)) * 0.05])
    rows = [(k, x.astype(np.float32).tolist(), int(k % 2) if k % 17 else None) for k, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, [float("inf")] * 16, 1), (1006, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: r for r in near_vectors(df, window=32, block_rows=64).collect()}
    x = np.array([r[1] for r in rows[: len(v)]])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    lab = [r[2] for r in rows[: len(v)]]
    near = [(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.93), strict=True) if a < b and lab[a] is not None and lab[a] == lab[b]]
    n = collections.Counter(int(i) for e in near for i in e)
    want = groups([r[0] for r in rows], [(int(a), int(b)) for a, b in near])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_a_dense_label(spark):
    """One label of vectors crowded round a mean, with planted pairs: no link is lost."""
    from riskframe.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal(64)) * 0.85**0.5 + unit(rng.standard_normal((6000, 64))) * 0.15**0.5)
    x[:300] = unit(x[300:600] + unit(rng.standard_normal((300, 64))) * 0.35)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {r.id: (r.n_links, r.component_id) for r in near_vectors(df, block_rows=700).collect()}
    cosine = unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T
    near = (cosine >= 0.93) & ~np.eye(len(x), dtype=bool)
    comp = groups(range(len(x)), np.argwhere(near).tolist())
    assert near[:300].any(1).sum() > 200
    assert got == {k: (int(near[k].sum()), comp[k]) for k in range(len(x))}


def test_near_vectors_of_odd_ids(spark):
    """Null ids, ids that stand with equal and with different vectors, columns of clashing names, doubles, all copies."""
    from riskframe.llm.embedding_dedup import near_vectors

    rows = [(None, [1.0, 0.0], 1, 7), (1, [1.0, 0.0], 1, 7), (1, [1.0, 0.0], 1, 8), (2, [2.0, 0.01], 1, 9), (3, [0.0, 1.0], 1, 9), (3, [1.0, 0.02], 1, 9), (4, [1.0, 0.0], 2, 9), (5, [1.0, 0.0], None, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component int")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    copies = df.where("vec_id = 4").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn("vec_id", F.col("n").cast("long")).drop("n")
    assert near_vectors(copies).groupBy("n_links", "component_id").count().collect() == [(499, 1, 500)]


def test_top_k(spark):
    from riskframe.llm.topk_search import top_k

    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (300, 6)) / 8.0  # many ties
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (1000, [1.0, float("nan")] * 3), (1100, [None] * 6), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").union(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, top_k(df, "id % 100 = 0", shard=50, block=2, leaf=8).collect()))
    q = np.floor(v * 1024).astype(int)
    want = []
    for i in (0, 100, 200):
        s = q @ q[i]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate([j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != i][:10])]
    assert got == want
    assert top_k(df.limit(0), "id % 100 = 0").count() == 0


def test_top_k_of_split_cells(spark, monkeypatch):
    """More shards than cells: a cell is several shards, none larger; a tree goes only where a query asks for its cell, once for every `block` queries."""
    from riskframe.llm import topk_search

    monkeypatch.setattr(topk_search, "MOST_LEVELS", 1)
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(600, 5)), 2)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.top_k(df, "id % 50 = 0", shard=30, block=1, leaf=8).collect()))
    q = np.floor(v * 1024).astype(int)
    want = []
    for i in range(0, 600, 50):
        s = q @ q[i]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate([j for j in sorted(range(600), key=lambda j: (-s[j], j)) if j != i][:10])]
    assert got == want
    trees = spark.createDataFrame([(5, c, p) for c in (1, 2, 3) for p in (0, 1)], "dim int, cell int, part int")
    cells = spark.createDataFrame([(5, c, 2) for c in (1, 2, 3)], "dim int, cell int, parts int")
    route = spark.createDataFrame([(5, 2, bytes(8 * 3)), (5, 2, bytes(8 * 2)), (5, 3, bytes(8))], "dim int, cell int, ids binary")
    sent, asked = topk_search._spread(trees, cells, route, block=4)
    assert sorted((r.cell, r.part, r.piece) for r in sent.collect()) == [(2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1), (3, 0, 0), (3, 1, 0)]
    assert sorted((r.cell, r.part, len(r.ids) // 8) for r in asked.collect()) == [(2, 0, 2), (2, 0, 3), (2, 1, 2), (2, 1, 3), (3, 0, 1), (3, 1, 1)]


def test_top_k_of_large_components(spark):
    """Components whose products pass what doubles hold exactly, clustered vectors, null ids, a column of a clashing name."""
    from riskframe.llm.topk_search import top_k

    rnd = random.Random(5)
    near = [[rnd.gauss(c, 1) for _ in range(4)] for c in range(-20, 20) for _ in range(20)]
    big = [[200000.0, 1.0, 0.0, -3.0], [1.5e6, -2.5e6, 3.25, 1.0], [2.0**25, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0]]
    rows = [(k, x, 7) for k, x in enumerate(big + near)] + [(None, big[0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, top_k(df, "id % 100 = 0 and id != 2", shard=64, leaf=8).collect()))
    q = [[int(np.floor(1024 * e)) for e in x] for _, x, _ in rows[:-1]]
    want = []
    for i in range(0, len(q), 100):
        s = {j: sum(a * b for a, b in zip(q[i], q[j], strict=True)) for j in range(len(q)) if j != i}
        want += [(i, n + 1, j, s[j]) for n, j in enumerate(sorted(s, key=lambda j: (-s[j], j))[:10])]
    assert got == want
    with pytest.raises(Exception, match="doesn't fit a long"):
        top_k(df.where("vec_id in (0, 2)").withColumn("embedding", F.transform("embedding", lambda e: e * 1e6)), "id = 2").collect()


@pytest.mark.parametrize("window", [20, 3])
def test_cut_repeats(spark, docs, window):
    from riskframe.llm.substring_dedup import cut_repeats, maximal_repeats

    out = cut_repeats(docs.withColumn("n_words", F.lit("clash")), window=window, group=200)
    assert set(docs.columns) < set(out.columns)
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        want[r.doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == want
    assert cut_repeats(docs.limit(0)).count() == 0
    spans = collections.Counter()
    for r in maximal_repeats(docs, window=window, group=200).collect():
        assert r.length >= window
        spans[r.id] += r.length
    # spans that overlap are told apart only where a window between them is new
    assert spans.keys() == {i for i, w in want.items() if w[1]} and all(spans[i] >= want[i][1] for i in spans)


def test_cut_repeats_over_small_batches(spark, docs):
    """Ids that fall and rise within a task, windows that later batches hold again: the same rows as in one batch."""
    from riskframe.llm.substring_dedup import cut_repeats

    mixed = docs.unionByName(docs.withColumn("doc_id", 500 - F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).coalesce(1)
    want = sorted(map(tuple, cut_repeats(mixed, window=5).collect()), key=str)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        assert sorted(map(tuple, cut_repeats(mixed, window=5, group=300).collect()), key=str) == want
    finally:
        spark.conf.set(name, before)


def test_packed_numbers():
    from riskframe.llm.substring_dedup import _packed, _unpacked

    for x in ([], [5], [-3], [-(2**63), 2**63 - 1, 0, 0, 7], [1, 2, 3, 500, 70000], list(range(1000)), [9, 4, 4, 2**40]):
        assert _unpacked(_packed(np.array(x, np.int64))).tolist() == x


def test_repeated_rows_are_one_document(spark):
    from riskframe.llm.substring_dedup import cut_repeats

    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in cut_repeats(df).collect())
    assert got == [("1", 0), ("1", 0), ("None", 30)]
    # one id with two texts: each repeats itself no more than once
    df = spark.createDataFrame([(1, text), (1, text + " x"), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in cut_repeats(df).collect()) == [(1, 0), (1, 30), (2, 30)]


def test_mix(spark, docs):
    from riskframe.llm.source_mix import mix, mixed_documents, taken_words, word_count

    stream, schedule = mix(docs, block=64)
    got = taken_words(stream, schedule).collect()
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert sorted((r.id, r.size) for r in got) == sorted(size.items())
    assert all(r.taken <= 3 * r.size for r in got)
    by, target = collections.Counter(), {}
    for r in got:
        by[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(by[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    order = sorted(target, key=lambda s: (s is None, (s or "").encode()))
    total = collections.Counter()
    for r in docs.collect():
        total[r.source] += size[r.doc_id]
    open_, rest, want = dict(zip(order, [5, 2, 1, 5, 2], strict=False)), sum(size.values()), {}
    while True:
        level = rest / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * total[s]
            rest -= want[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)
    assert {(r.id, r.taken) for r in got} == {(r.id, r.taken) for r in taken_words(*mix(docs.repartition(3), block=64)).collect()}
    mixed = mixed_documents(docs, block=64)
    assert mixed.columns == docs.columns and mixed.agg(F.sum(word_count(F.col("text")))).first()[0] == sum(by.values())
    # in the schedule's order, a third column that clashes, null ids and repeated rows
    rows = mixed_documents(docs.withColumn("position", F.lit("clash")), block=64, slot_col="at").collect()
    assert [r.at for r in rows] == sorted(r.at for r in rows)
    hot = [r.source == "hot" for r in rows]
    assert abs(sum(hot[: len(hot) // 2]) / max(1, len(hot) // 2) - sum(hot) / len(hot)) < 0.25
    odd = spark.createDataFrame([(None, "a b c", "fr", None, 5), (None, "a b c", "fr", None, 6), (None, "d e f g", "fr", "x", 7)], DOCS)
    assert sorted((r.text, r.n_chars) for r in mixed_documents(odd, block=2, share=1.0).collect())
    assert mixed_documents(odd, block=2).agg(F.sum(word_count(F.col("text")))).first()[0] == 10
    assert mixed_documents(docs.limit(0)).count() == 0
    empty = mix(docs.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
    assert taken_words(*mix(docs.where("text is null"))).collect()[0].taken == 0


def test_bpe_matches_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    from riskframe.llm.bpe import decode_ids, encode_texts
    from riskframe.llm.queries import _tokenizer

    odd = ["Hello  WORLD's 123 café <|endoftext|> xİ’s don't 'LL ​中文 <|STARTOFTEXT|>y _a_b 1½", "a<|endoftext|>b", "\x00\x01\x1c\x85 😀", "ΑΣ ΑΣΑ", "é ́x", "x" * 500, "!?" * 100, "\ua7dc\U00010d50 \U00016ea0\ua7ce", "".join(random.Random(3).choices("abcdefghij", k=100_000)), "ab" * 3000, "é中" * 3000, "퟿ 𝒳"]
    extra = spark.createDataFrame([(5000 + k, t, None, None, 0) for k, t in enumerate(odd)], DOCS)
    lib = tokenizers.Tokenizer.from_file(_tokenizer())
    lib.no_padding()
    lib.no_truncation()
    rows = decode_ids(encode_texts(docs.union(extra).withColumn("n_tokens", F.lit("clash")), _tokenizer()), _tokenizer()).collect()
    assert len(rows) == docs.count() + len(odd)
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert encode_texts(docs.limit(0), _tokenizer()).count() == 0


def test_bpe_of_any_characters():
    """Runs of characters of all planes below U+3000, in any neighbourhood, as the library encodes them."""
    tokenizers = pytest.importorskip("tokenizers")
    from riskframe.llm.bpe import Encoder, vocabulary
    from riskframe.llm.queries import _tokenizer

    encoder, lib = Encoder(vocabulary(_tokenizer())), tokenizers.Tokenizer.from_file(_tokenizer())
    lib.no_padding()
    lib.no_truncation()
    rnd, chars = random.Random(1), [chr(c) for c in range(0x3000)]
    for k in range(6000):
        text = "".join(rnd.choice(chars if k % 2 else chars[:0x260]) + rnd.choice(["", "a", "1", " ", "!", "'s", "Σ"]) for _ in range(12))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, [text]


def test_chat_windows(spark):
    from riskframe.llm.chat_format import chat_windows, read_windows

    rnd = random.Random(2)
    rows = []
    for c in range(25):
        roles = (["system"] if c % 2 else []) + [["user", "assistant"][k % 2] for k in range(rnd.randint(1, 30))]
        rows += [(c, k, r, rnd.choice(["", None, "<|im_end|>", "a\\b <\\| <| \\", "é" * rnd.randint(0, 900), "plain words " * rnd.randint(1, 60)])) for k, r in enumerate(roles)]
    rows += [(None, 1, "user", "hi"), (None, 2, "assistant", "ho"), (77, 1, "assistant", "same"), (77, 1, "assistant", "same"), (78, None, None, "x"), (79, 0, "we ird\n<|role", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_windows(df)
    got = {r.conv_id: r for r in read_windows(out).collect()}
    conv = collections.defaultdict(list)
    for c, k, role, text in rows:
        conv[c].append((k if k is not None else 1e9, role or "", text or ""))
    assert got.keys() == conv.keys()
    for c, turns in conv.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss_text == "".join(t for _, r, t in turns if r == "assistant")
    first = {c: sorted(t)[0][1] for c, t in conv.items()}
    for w in out.where("window > 0 or part > 0").collect():
        assert w.formatted.startswith("<|im_start|>system\n") == (first[w.conv_id] == "system")
        assert w.n_tokens <= 512 or w.n_turns == 1
    assert chat_windows(df.limit(0)).count() == 0
    few = {r.conv_id: r for r in read_windows(chat_windows(df.withColumn("window", F.lit("clash")), part_turns=3)).collect()}
    assert {c: (r.turns, r.loss_text) for c, r in few.items()} == {c: (r.turns, r.loss_text) for c, r in got.items()}
    for w in chat_windows(df, part_turns=3).where("part > 0 and n_context > 0").collect():
        assert w.formatted.startswith("<|im_start|>system\n") == (first[w.conv_id] == "system")


def test_chat_windows_of_a_long_conversation(spark):
    from riskframe.llm.chat_format import chat_windows, read_windows

    text = lambda k: f"turn {k} " + "word " * (k % 40)
    rows = [(1, 0, "system", "be kind")] + [(1, k, ["assistant", "user"][k % 2], text(k)) for k in range(1, 10_001)]
    out = chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = read_windows(out).first()
    assert [t.text for t in r.turns] == [x[3] for x in rows] and r.loss_text == "".join(text(k) for k in range(2, 10_001, 2))
    least = out.agg(F.max("n_tokens"), F.min(F.when(F.col("window") + F.col("part") > 0, F.col("n_context")))).first()
    assert least[0] <= 512 and least[1] >= 2  # the system turn and history


def test_urls(spark):
    from riskframe.llm.url_filter import judge_urls

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "a.example.com", ""), ("block", "net", "/"), ("allow", "net", "/a"), ("block", "net", "/ab"), ("allow", None, "/x"), ("block", "org", None)]
    rnd = random.Random(4)
    hosts = ["com", "example.com", "EXAMPLE.com", "a.example.com", "b.a.example.com", "xexample.com", "net", "x.net", "example.net.", ".com", "", "com.", "u@h.com:80", "é.net"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/a', '/abc#f', '/x/en/', '?q', '#/en/'])}" for _ in range(200)]
    urls += [None, "", "nothing", "://", "http:/com/en/", "http://com/en/http://net/a"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert got[k] == (host, path, best[3], best[4]), u
    twice = judge_urls(pages.unionByName(pages.where("page_id < 50")), spark.createDataFrame(rules, "verdict string, host string, path string"))  # repeated rows
    assert twice.count() == len(urls) + 50 and all((r.host, r.path, r.rule, r.verdict) == got[r.page_id] for r in twice.collect())
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert judge_urls(pages, none).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert judge_urls(pages.limit(0), none).count() == 0


def test_warc(spark):
    from riskframe.llm.warc import archive_folder, payload_digest, read_archives, write_archives

    rnd = random.Random(6)
    html = [None, "", "<p>é</p>\r\n\r\nWARC/1.1\r\n"] + [f"<html><body>{'word ' * rnd.randint(1, 300)}{k}</body></html>" for k in range(60)]
    rows = [(k, rnd.choice([None, f"http://x/{k}", "http://x/ a\r\nb"]), html[k] if k < len(html) else rnd.choice(html)) for k in range(150)] + [(None, "u", "null id")]
    folder = archive_folder(spark)
    archives = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, archive_bytes=4000, dictionary_bytes=2048)
    assert archives.count() > 3
    got = {r.id: r for r in read_archives(spark, folder, archives).collect()}
    owner = {}
    for k, _, h in rows:
        if k is not None:
            owner[h or ""] = max(owner.get(h or "", -1), k)
    assert len(got) == len(rows)
    for k, _, h in rows:
        body = (h or "").encode()
        own = k is None or owner[h or ""] == k
        r = got[k]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), payload_digest(body), "response" if own else "revisit", None if own else owner[h or ""])
        assert r.payload == (body if own else None)
    # repeated rows, a column of a clashing name: each row is a record
    folder = archive_folder(spark)
    again = spark.createDataFrame([(1, "u", "x", 1), (1, "u", "x", 2), (2, "u", "x", 3)], "page_id long, url string, html string, sha int")
    assert sorted((r.id, r.record_type, r.refers_to or 0) for r in read_archives(spark, folder, write_archives(again, folder)).collect()) == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", 0)]
    none = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), archive_folder(spark))
    assert read_archives(spark, folder, none).count() == 0


def test_toxicity(spark):
    import zlib

    from riskframe.llm.toxicity import toxicity

    rnd = random.Random(8)
    rows, labels = [], []
    for k in range(1500):
        bad = rnd.random() < 0.2
        text = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(5, 60))] + ([rnd.choice(["badword", "worseword"])] * 2 if bad else [])
        rnd.shuffle(text)
        rows.append((k, " ".join(text), "clash"))
        if k % 2:
            labels.append((k, int(bad)))
    rows += [(5000, None, ""), (5001, "", ""), (None, "badword", "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    assert got[5000].score == got[5001].score
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    # labels of the held-out fold change nothing
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(docs, flipped).collect()}
    assert all(abs(again[k] - r.score) < 1e-12 for k, r in got.items())
    assert toxicity(docs.limit(0), marks).count() == 0
    assert toxicity(docs, marks.limit(0)).select("score").distinct().count() == 1


def test_toxicity_scores_by_hand(spark):
    """Every document's score, from the model's weights and its own words in plain Python; repeated rows, very long, empty and null texts."""
    import math
    import zlib

    import xxhash

    from riskframe.llm.toxicity import PLACES, toxicity, toxicity_model

    rnd = random.Random(12)
    rows = [(k, " ".join(rnd.choice(["Good", "word", "BAD-thing", "été", "nasty", "über", f"w{rnd.randint(0, 50)}"]) for _ in range(rnd.randint(1, 30)))) for k in range(600)]
    rows += [rows[3], rows[3], (900, None), (901, ""), (902, "bad nasty " * 50_000), (None, "nasty")]
    marks = [(k, int("nasty" in t)) for k, t in rows[:600:2]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    weight, bias = toxicity_model(docs, labels)
    assert weight and len(weight) <= 512

    def score(text):
        folded = "".join(chr(b) if chr(b).isascii() and chr(b).isalpha() else " " if b < 128 else chr(b) for b in (text or "").encode()).lower() if (text or "").isascii() else None
        raw = (text or "").encode()
        spaced = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in raw)
        assert folded is None or folded.encode() == spaced
        places = set()
        for w in spaced.split():
            places |= {xxhash.xxh3_64_intdigest(w) % PLACES} | {xxhash.xxh3_64_intdigest(w[:n], 1) % PLACES for n in (5, 6, 7) if len(w) >= n}
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weight.get(p, 0.0) for p in places)))))

    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - score(r.text)) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize("labelled, other", [(0.2, 0.01), (0.1, 0.5)])
def test_toxicity_where_labels_are_not_like_documents(spark, labelled, other):
    """The share of documents called toxic is not tied to the share of labels."""
    from riskframe.llm.toxicity import toxicity

    rnd = random.Random(9)
    rows, labels = [], []
    for k in range(4000):
        bad = rnd.random() < (labelled if k < 1000 else other)
        text = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(5, 60))] + ([rnd.choice(["badword", "worseword"])] * 2 if bad else [])
        rows.append((k, " ".join(text), bad))
        if k < 1000:
            labels.append((k, int(bad)))
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string, bad boolean"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    hit = sum(r.predicted and r.bad for r in got)
    assert hit > 0.95 * sum(r.predicted for r in got) and hit > 0.95 * sum(r.bad for r in got)
