"""The pipeline, stage by stage, against brute force on the smallest tables."""

import pytest

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from riskframe.llm.common import saved

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, SF), name)
        results.append((name, before, docs))
    assert [n for n, _, _ in results] == ["toxicity", "minhash_dedup", "substring_dedup", "source_mix", "bpe"]
    assert all(d.columns == columns for _, _, d in results[:-1])
    _, before, after = results[1]
    sets = {}
    for r in before.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    kept = {r.doc_id for r in after.collect()}
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(a, b) for b in sets if b < a) for a in sets.keys() - kept)
    _, before, after = results[2]
    seen = set()
    for r in sorted(after.collect(), key=lambda r: r.doc_id):
        w = (r.text or "").split()
        own = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        assert not own & seen
        seen |= own
    _, before, after = results[3]
    n = lambda d: sum(len((r.text or "").split()) for r in d.collect())
    assert abs(n(after) - n(before)) <= 30
    assert results[4][1].count() == results[4][2].count()
    assert corpus_pipeline.run(spark, SF).count() == results[4][2].count()


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing column, and an empty table, in every stage."""
    words = " ".join(f"w{k}" for k in range(80))
    rows = [
        (1, words, "en", "a", 1, "x"), (1, words, "en", "a", 1, "x"), (2, words + " tail", None, None, None, None), (3, None, None, "a", None, None), (4, "", "en", "b", 0, "y"),
        (None, "one two three four five six", None, None, None, None), (6, "other words here " * 30_000, "fr", "b", 9, "z"), (7, f"lead {words} end of it all", "fr", "b", 9, "z"), (8, " \n\t ", "fr", "b", 9, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, position string")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "bpe":
            assert stage(spark, docs, SF).columns == docs.columns
    clean = stages["toxicity"](spark, docs, SF)
    assert set(ids(clean)) <= {r[0] for r in rows}
    assert ids(stages["minhash_dedup"](spark, docs, SF)) == sorted([1, 1, 3, 4, None, 6, 8], key=str)
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, docs, SF).collect()}
    assert cut[1].text == words and cut[2].text == "tail" and cut[7].text == "lead end of it all" and cut[7].n_chars == 18 and cut[3].text is None and cut[8].text == " \n\t "
    assert len(cut[6].text.split()) < 100  # it repeats itself
    mixed = stages["source_mix"](spark, docs, SF)
    assert {3, 4, 8}.isdisjoint(ids(mixed)) and mixed.where("n_chars != length(text)").isEmpty()
    done = {r.doc_id: r for r in stages["bpe"](spark, docs, SF).collect()}
    assert done[3].n_tokens == done[4].n_tokens == done[8].n_tokens == 0 and done[6].n_tokens >= 90_000
