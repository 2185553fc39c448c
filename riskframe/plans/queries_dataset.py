"""Queries over dataset preparation, models, evaluation, candidates, reports and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import collections as C
from ..operators import dataset as D
from ..operators import evaluate as V
from ..operators import search as H
from ..operators import statistics as S
from .queries_features import TRIPLES, doc_triples
from ..storage import shared_folder
from .registry import Tables, query


@query("load_by_group_limit", "select year(o_orderdate) as grp, o_orderkey from orders where year(o_orderdate) in (1995, 1996, 1997) qualify row_number() over (partition by year(o_orderdate) order by o_orderkey) <= 50")
def load_by_group_limit(t: Tables) -> DataFrame:
    return D.load_by_group(t.orders, F.year("o_orderdate"), [1995, 1996, 1997], "o_orderkey", 50).select("grp", "o_orderkey")


@query(
    "load_grouped",
    f"""with {TRIPLES}, g as (select entity, feature, value, case when starts_with(feature, 'lang_') then 1 when starts_with(feature, 'description_') then 2 when starts_with(feature, 'reference_') then 3 when starts_with(feature, 'vendor_') then 4 else 0 end as grp
    from triples where not starts_with(feature, 'exploits_'))
    select entity, {", ".join(f"coalesce(string_agg(value::bigint, ',' order by feature) filter (grp = {k}), '') as group_{k}" for k in range(5))} from g group by 1""",
)
def load_grouped(t: Tables) -> DataFrame:
    g = D.load_grouped(doc_triples(t).where("not startswith(feature, 'exploits_')"), S.feature_group(F.col("feature")))
    return g.select("entity", *(F.array_join(F.transform(f"group_{k}", lambda x: x.cast("long").cast("string")), ",").alias(f"group_{k}") for k in range(5)))


@query(
    "load_dataset",
    f"""with {TRIPLES}, y as (select entity, 2000 + entity % 3 as grp, array_to_string(list(value::bigint order by feature) filter (not starts_with(feature, 'exploits_')), ',') as features,
    coalesce(max(case when feature = 'exploits_has' then value end), 0)::int as label from triples group by 1)
    select entity, grp, coalesce(features, '') as features, label from y where grp in (2000, 2002) qualify row_number() over (partition by grp order by entity) <= 40""",
)
def load_dataset(t: Tables) -> DataFrame:
    data = S.assemble_dataset(doc_triples(t), "exploits_").drop("index")
    d = D.load_dataset(data, 2000 + F.col("entity") % 3, [2000, 2002], limit=40)
    return d.withColumn("features", F.array_join(F.transform("features", lambda x: x.cast("long").cast("string")), ","))


@query(
    "to_vector",
    f"with {TRIPLES}, v as (select feature, row_number() over (order by feature) as place from (select distinct feature from triples)) select entity, round(sum(value * place), 3) as weighted, (select count(*) from v) as width from triples join v using (feature) group by 1",
)
def to_vector(t: Tables) -> DataFrame:
    triples = doc_triples(t)
    v = D.to_vector(triples, D.vocabulary(triples))
    total = F.aggregate(F.transform("features", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("entity", F.round(total, 3).alias("weighted"), F.size("features").cast("long").alias("width"))


@query("parse_selection", "select o_orderkey, [o_orderkey % 7 + 1990, o_orderkey % 5 + 2000] as years, (o_orderkey % 100)::int as cap from orders")
def parse_selection(t: Tables) -> DataFrame:
    text = F.concat((F.col("o_orderkey") % 7 + 1990).cast("string"), F.lit(","), (F.col("o_orderkey") % 5 + 2000).cast("string"), F.lit(":"), (F.col("o_orderkey") % 100).cast("string"))
    years, cap = D.parse_selection(text)
    return t.orders.select("o_orderkey", years.cast("array<bigint>").alias("years"), cap.alias("cap"))


@query("slice_groups", "select vec_id, round(list_sum(embedding[1:10]::double[]), 5) as a, round(list_sum(embedding[11:30]::double[]), 5) as b, len(embedding[31:]) as c from embeddings where embedding is not null")
def slice_groups(t: Tables) -> DataFrame:
    a, b, c = D.slice_groups(F.col("embedding").cast("array<double>"), [(0, 10), (10, 30), (30, -1)])
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 5)
    return t.embeddings.where("embedding is not null").select("vec_id", total(a).alias("a"), total(b).alias("b"), F.size(c).cast("long").alias("c"))


@query("label_codes", "select c_mktsegment as label, dense_rank() over (order by c_mktsegment) - 1 as code from (select distinct c_mktsegment from customer where c_mktsegment is not null)")
def label_codes(t: Tables) -> DataFrame:
    return D.label_codes(t.customer, "c_mktsegment")


def _bits(x: str, n: int) -> str:
    return " || ".join(f"(({x} >> {k}) & 1)" for k in range(n - 1, -1, -1))


@query(
    "encode_labels",
    f"""select vec_id, label::varchar as incremental, (label + 1)::varchar as incremental1, {_bits("label", 4)} as bin, {_bits("(label + 1)", 4)} as bin1,
    {" || ".join(f"(label = {k})::int" for k in range(10))} as sparse, {" || ".join(f"case when label = {k} then label else 0 end" for k in range(10))} as distinct_sparse,
    {" || ".join(f"case when label = {k} then label + 1 else 0 end" for k in range(10))} as distinct_sparse1, (1 << label)::varchar as exponential from embeddings where label is not null""",
)
def encode_labels(t: Tables) -> DataFrame:
    kinds = {"incremental": "incremental", "incremental1": "incremental+1", "bin": "binary", "bin1": "binary+1", "sparse": "sparse", "distinct_sparse": "distinct-sparse", "distinct_sparse1": "distinct-sparse+1", "exponential": "exponential"}
    text = lambda e: F.array_join(F.transform(D.encode_label(F.col("label"), e, 9), lambda x: x.cast("string")), "")
    return t.embeddings.where("label is not null").select("vec_id", *(text(e).alias(n) for n, e in kinds.items()))


@query("decode_labels", "select c_custkey, coalesce(case when c_custkey % 6 < 5 then (select list(distinct c_mktsegment order by c_mktsegment) from customer)[(c_custkey % 6)::int + 1] end, 'Abscent') as label from customer")
def decode_labels(t: Tables) -> DataFrame:
    codes = D.label_codes(t.customer, "c_mktsegment").where("code < 5")
    return D.decode_label(t.customer.select("c_custkey", (F.col("c_custkey") % 6).alias("code")), "code", codes).select("c_custkey", "label")


@query("decode_pair", "select c_custkey, case when c_custkey % 9 < 5 then (select list(distinct c_mktsegment order by c_mktsegment) from customer)[(c_custkey % 9)::int + 1] when c_custkey % 9 < 8 then (select list(distinct o_orderstatus order by o_orderstatus) from orders)[(c_custkey % 9)::int - 4] else 'Abscent' end as label from customer")
def decode_pair(t: Tables) -> DataFrame:
    at = F.col("c_custkey") % 9
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k == at).cast("int"))
    return D.decode_pair(t.customer.select("c_custkey", vector.alias("v")), "v", D.label_codes(t.customer, "c_mktsegment"), D.label_codes(t.orders, "o_orderstatus")).select("c_custkey", "label")


@query("one_vs_rest", "select c_custkey, case when c_mktsegment = 'BUILDING' then c_mktsegment else 'Abscent' end as label, coalesce((c_mktsegment = 'BUILDING')::int, 0) as is_match from customer")
def one_vs_rest(t: Tables) -> DataFrame:
    return D.one_vs_rest(t.customer.select("c_custkey", F.col("c_mktsegment").alias("label")), "label", "BUILDING", "Abscent").select("c_custkey", "label", "is_match")


@query(
    "normalize_vectors",
    """with x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from embeddings), r as (select p, min(x) as lo, max(x) as hi from x group by 1)
    select vec_id, round(sum((x - lo) / (hi - lo)), 5) as total from x join r using (p) group by 1""",
)
def normalize_vectors(t: Tables) -> DataFrame:
    n = D.normalize_vectors(t.embeddings.select("vec_id", "embedding"), "embedding")
    return n.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), 5).alias("total"))


@query("shuffle_rows", "select doc_id, n_chars from documents")
def shuffle_rows(t: Tables) -> DataFrame:
    return D.shuffle_rows(t.documents.select("doc_id", "n_chars"), "doc_id", 3)


def _numbered(table: str, order: str) -> str:
    return f"n as (select *, row_number() over (order by {order}) - 1 as rn, count(*) over () as n from {table})"


@query("split_at", f"with {_numbered('orders', 'o_orderdate, o_orderkey')} select o_orderkey, case when rn < floor(n * 0.85) then 'head' else 'tail' end as part from n")
def split_at(t: Tables) -> DataFrame:
    return D.split_at(t.orders.select("o_orderdate", "o_orderkey"), 0.85, "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@query(
    "balance_classes",
    """with r as (select doc_id, toxic, row_number() over (partition by toxic order by doc_id) as r from labels where toxic is not null), m as (select min(c) as m from (select count(*) as c from r group by toxic))
    select doc_id, toxic from r, m where r <= m""",
)
def balance_classes(t: Tables) -> DataFrame:
    return D.balance_classes(t.labels.where("toxic is not null").select("doc_id", "toxic"), "toxic", "doc_id").select("doc_id", "toxic")


@query("kfold_assign", f"with {_numbered('customer', 'c_custkey')} select c_custkey, least(floor(rn * 5 / n), 4)::int as fold from n")
def kfold_assign(t: Tables) -> DataFrame:
    return D.kfold(t.customer.select("c_custkey"), 5, "c_custkey")


@query(
    "rolling_folds",
    f"""with {_numbered('supplier', 's_suppkey')}, w as (select any_value(n) as n, greatest(floor(any_value(n) / 2 / 4), 1) as w from n),
    f as (select fold, w, least(floor(n / 2) + fold * w, n - w) as s from w, (select unnest([0, 1, 2, 3]) as fold))
    select s_suppkey, fold, case when rn < s then 'train' else 'validate' end as role from n, f where rn < s + w""",
)
def rolling_folds(t: Tables) -> DataFrame:
    return D.rolling_folds(t.supplier.select("s_suppkey"), 4, "s_suppkey")


@query("assign_batches", f"with {_numbered('customer', 'c_custkey')} select c_custkey, (rn // 64)::bigint as batch from n")
def assign_batches(t: Tables) -> DataFrame:
    return D.assign_batches(t.customer.select("c_custkey"), 64, "c_custkey")


def _training(t: Tables) -> DataFrame:
    """Vectors with a 0/1 label."""
    return t.embeddings.where("embedding is not null and label is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") < 5).cast("int").alias("y"))


@query("train_predict")
def train_predict(t: Tables) -> DataFrame:
    rows = _training(t)
    return V.predict(rows, V.train_weighted(rows, "features", "y"), "features").select("vec_id", "y", "confidence", "predicted")


@query("train_mlp")
def train_mlp(t: Tables) -> DataFrame:
    rows = _training(t)
    return V.predict(rows, V.train_mlp(rows, "features", "y", [64, 8, 2], 10), "features").select("vec_id", "y", "confidence", "predicted")


@query("train_stacked")
def train_stacked(t: Tables) -> DataFrame:
    a, b, c = D.slice_groups(F.col("features"), [(0, 20), (20, 40), (40, -1)])
    rows = _training(t).withColumns({"g0": a, "g1": b, "g2": c})
    models, top = V.train_stacked(rows, ["g0", "g1", "g2"], "y")
    return V.predict(V.stack(rows, models), top, "__stack").select("vec_id", "y", "confidence", "predicted")


@query("evaluate_model")
def evaluate_model(t: Tables) -> DataFrame:
    rows = D.split_at(_training(t), 0.85, "vec_id")
    model = V.train_weighted(rows.where("part = 'head'"), "features", "y")
    return V.binary_metrics(V.confusion(V.predict(rows.where("part = 'tail'"), model, "features"), "y", "predicted"))


@query("evaluate_years")
def evaluate_years(t: Tables) -> DataFrame:
    """A stored model read back and evaluated over chosen years; the vectors' years are drawn from their ids."""
    rows = D.split_at(_training(t).withColumn("year", (F.col("vec_id") % 5 + 2015).cast("int")), 0.85, "vec_id")
    at = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    V.save_model(V.train_weighted(rows.where("part = 'head'"), "features", "y"), at)
    return V.evaluate_years(V.load_model(at), rows.where("part = 'tail'"), "features", "y", F.col("year"), [2016, 2018])


@query("threshold_classes", "select event_id, (value / 100 >= 0.5)::int as predicted from events")
def threshold_classes(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.threshold_class(F.col("value") / 100).alias("predicted"))


@query("argmax_classes", "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as predicted from embeddings where embedding is not null")
def argmax_classes(t: Tables) -> DataFrame:
    return t.embeddings.where("embedding is not null").select("vec_id", V.argmax_class(F.col("embedding")).alias("predicted"))


CONFUSION = "c as (select sum((quality = 1 and toxic = 1)::int)::bigint as tp, sum((quality <> 1 and toxic <> 1)::int)::bigint as tn, sum((quality <> 1 and toxic = 1)::int)::bigint as fp, sum((quality = 1 and toxic <> 1)::int)::bigint as fn from labels)"


@query("confusion", f"with {CONFUSION} select * from c")
def confusion(t: Tables) -> DataFrame:
    return V.confusion(t.labels, "quality", "toxic")


@query(
    "binary_metrics",
    f"with {CONFUSION} select tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c",
)
def binary_metrics(t: Tables) -> DataFrame:
    m = V.binary_metrics(V.confusion(t.labels, "quality", "toxic"))
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


# scores of the evaluation queries: the events' values, the label is a purchase
SCORES = "s as (select value as score, sum((event_type = 'purchase')::int) as y, count(*) as n from events group by 1), cum as (select score, sum(y) over w as tp, sum(n - y) over w as fp, sum(y) over () as p, sum(n - y) over () as q from s window w as (order by score desc))"


def _scored(t: Tables) -> DataFrame:
    return t.events.select("value", (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(
    "soft_metrics",
    """with c as (select (event_type = 'purchase')::int::double as y, least(greatest(value / 100, 0), 1) as s from events),
    n as (select sum(case when y * s > 0.5 then 1.0 else 0 end) as tp, sum(case when s > 0.5 then 1.0 else 0 end) as pp, sum(y) as ap from c), m as (select tp / pp as p, tp / ap as r from n)
    select round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from m""",
)
def soft_metrics(t: Tables) -> DataFrame:
    m = V.soft_metrics(_scored(t).withColumn("s", F.col("value") / 100), "y", "s")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("roc_curve", f"with {SCORES} select score, round(fp / q, 6) as fpr, round(tp / p, 6) as tpr from cum")
def roc_curve(t: Tables) -> DataFrame:
    return V.roc_curve(_scored(t), "y", "value").select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


ROC_AUC = f"{SCORES}, pt as (select fp / q as x, tp / p as y, lag(fp / q, 1, 0) over (order by score desc) as x0, lag(tp / p, 1, 0) over (order by score desc) as y0 from cum)"


@query("roc_auc", f"with {ROC_AUC} select round(sum((x - x0) * (y + y0) / 2), 6) as auc from pt")
def roc_auc(t: Tables) -> DataFrame:
    return V.roc_auc(_scored(t), "y", "value").select(F.round("auc", 6).alias("auc"))


@query("pr_curve", f"with {SCORES} select score, round(tp / p, 6) as recall, round(tp / (tp + fp), 6) as precision from cum")
def pr_curve(t: Tables) -> DataFrame:
    return V.pr_curve(_scored(t), "y", "value").select("score", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    "pr_auc",
    f"with {SCORES}, pt as (select tp / p as x, tp / (tp + fp) as y, lag(tp / p, 1, 0) over (order by score desc) as x0, lag(tp / (tp + fp)) over (order by score desc) as y0 from cum) select round(sum((x - x0) * (y + coalesce(y0, y)) / 2), 6) as auc from pt",
)
def pr_auc(t: Tables) -> DataFrame:
    return V.pr_auc(_scored(t), "y", "value").select(F.round("auc", 6).alias("auc"))


@query(
    "smooth_curve",
    """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n, avg(value) over (partition by user_id order by event_id rows between 1 preceding and 1 following) as m from events)
    select event_id, round(case when rn <= 2 or rn > n - 2 then value else m end, 4) as smooth from r""",
)
def smooth_curve(t: Tables) -> DataFrame:
    return V.smooth(t.events, ["user_id"], "event_id", "value").select("event_id", F.round("smooth", 4).alias("smooth"))


def _sets(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("toxic in (0, 1)"), "doc_id").groupBy(F.col("lang").alias("name")).agg(F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("neg"), F.sum("toxic").cast("long").alias("pos"))


@query("random_baseline")
def random_baseline(t: Tables) -> DataFrame:
    return V.random_baseline(_sets(t), 100, 5)


@query("baseline_expected", "select lang as name, 0.5::double as accuracy, round(sum(toxic) / count(*), 6) as precision, 0.5::double as recall from documents join labels using (doc_id) where toxic in (0, 1) group by 1")
def baseline_expected(t: Tables) -> DataFrame:
    return _sets(t).select("name", F.lit(0.5).alias("accuracy"), F.round(F.col("pos") / (F.col("pos") + F.col("neg")), 6).alias("precision"), F.lit(0.5).alias("recall"))


@query(
    "normalize_curve",
    """with r as (select event_id, user_id, (value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0) as y, (event_id - min(event_id) over w) / nullif(max(event_id) over w - min(event_id) over w, 0) as x from events window w as (partition by user_id))
    select event_id, round(case when x is not null then least(greatest(x, 0), 1) end, 6) as nx, round(case when y is not null then 1 - least(greatest(y, 0), 1) end, 6) as ny from r""",
)
def normalize_curve(t: Tables) -> DataFrame:
    n = V.normalize_curve(t.events, ["user_id"], "event_id", "value")
    return n.select("event_id", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@query(
    "format_predictions",
    "select event_id::varchar || ': Label: ' || (event_type = 'purchase')::int || ' | Predicted Exploit: ' || (value >= 50)::int || ' | Conficende ' || printf('%.2f', floor(value)) || '% | Prediction Match: ' || case when (event_type = 'purchase') = (value >= 50) then 'True' else 'False' end as line from events",
)
def format_predictions(t: Tables) -> DataFrame:
    y, p = (F.col("event_type") == "purchase").cast("int"), (F.col("value") >= 50).cast("int")
    return t.events.select(V.format_prediction(F.col("event_id"), y, p, F.floor("value").cast("double") / 100).alias("line"))


@query("parse_predictions", "select event_id::varchar as key, (event_type = 'purchase')::int as label, (value >= 50)::int as predicted, round(floor(value) / 100, 4) as confidence, (event_type = 'purchase') = (value >= 50) as match from events where event_id % 5 <> 0")
def parse_predictions(t: Tables) -> DataFrame:
    lines = t.events.select(F.when(F.col("event_id") % 5 == 0, "Conficende broken").otherwise(V.format_prediction(F.col("event_id"), (F.col("event_type") == "purchase").cast("int"), (F.col("value") >= 50).cast("int"), F.floor("value").cast("double") / 100)).alias("line"))
    return V.parse_predictions(lines, "line")[0].withColumn("confidence", F.round("confidence", 4))


@query("mismatches", "select doc_id, quality, toxic, count(*) over () as wrong, (select count(*) from labels where quality is not distinct from toxic) as right from labels where quality is distinct from toxic")
def mismatches(t: Tables) -> DataFrame:
    wrong, totals = V.compare_labels(t.labels, "quality", "toxic")
    return wrong.select("doc_id", "quality", "toxic").join(F.broadcast(totals.select("wrong", "right")))


@query("match_totals", "select sum((quality is not distinct from toxic)::int)::bigint as matches, count(*) as total, round(100.0 * sum((quality is not distinct from toxic)::int) / count(*), 2)::double as percent from labels")
def match_totals(t: Tables) -> DataFrame:
    return V.match_totals(t.labels, "quality", "toxic")


#: Published areas under the ROC curve of four other predictors.
PUBLISHED = {"improving-vrtbep": 0.91, "epss": 0.87, "fastembed-nvd": 0.832, "fastembed-securityfocus": 0.912}


@query(
    "compare_baselines",
    f"with {ROC_AUC}, a as (select sum((x - x0) * (y + y0) / 2) as auc from pt) select name, published, round(auc - published, 6) as difference from a, (values {', '.join(f'''('{n}', {v}::double)''' for n, v in PUBLISHED.items())}) as b(name, published)",
)
def compare_baselines(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame(list(PUBLISHED.items()), "name string, published double")
    return known.join(F.broadcast(V.roc_auc(_scored(t), "y", "value"))).select("name", "published", F.round(F.col("auc") - F.col("published"), 6).alias("difference"))


@query("sample_candidates")
def sample_candidates(t: Tables) -> DataFrame:
    """As many candidates as there are suppliers, over ranges taken from the parts."""
    r = t.part.agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    return H.sample_candidates(t.spark, [("size", "INT", r[0], r[1]), ("price", "FLOAT", r[2], r[3]), ("flag", "BOOLEAN", 0, 1)], t.supplier.count(), 9)


@query("clamp_to_space", "select c_custkey, case when c_acctbal between 100 and 5000 then c_acctbal when abs(c_acctbal) between 100 and 5000 then abs(c_acctbal) else least(greatest(c_acctbal, 100), 5000) end as v from customer")
def clamp_to_space(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", H.clamp(F.col("c_acctbal"), 100.0, 5000.0).alias("v"))


# candidates: customers, their nation is the generation, their segment the lineage, their balance the output
@query(
    "rank_fitness",
    """select c_custkey, round(c_acctbal, 4) as absolute, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey)::double as incremental,
    round(100.0 / (count(*) over (partition by c_nationkey) - row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) + 2), 6) as relative from customer""",
)
def rank_fitness(t: Tables) -> DataFrame:
    out = t.customer
    for mode in ("absolute", "incremental", "relative"):
        out = H.rank_fitness(out, "c_acctbal", "c_custkey", mode, group=["c_nationkey"]).withColumn(mode, F.round("fitness", 6)).drop("fitness")
    return out.select("c_custkey", "absolute", "incremental", "relative")


@query(
    "roulette_bounds",
    """with f as (select c_custkey, c_nationkey, c_acctbal - least(min(c_acctbal) over (partition by c_nationkey), 0) as f from customer)
    select c_custkey, round(sum(f) over w - f, 3) as low, round(sum(f) over w, 3) as high from f window w as (partition by c_nationkey order by c_custkey)""",
)
def roulette_bounds(t: Tables) -> DataFrame:
    return H.roulette_bounds(t.customer, "c_acctbal", "c_custkey", ["c_nationkey"]).select("c_custkey", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("roulette")
def roulette(t: Tables) -> DataFrame:
    bounds = H.roulette_bounds(t.customer, "c_acctbal", "c_custkey", ["c_nationkey"])
    return H.roulette(bounds, ["c_nationkey"], 20, 4).select("c_nationkey", "draw", "c_custkey")


@query("leaderboard", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def leaderboard(t: Tables) -> DataFrame:
    return H.leaderboard(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


@query("best_ever", "select c_acctbal, c_nationkey, c_custkey from customer order by c_acctbal desc, c_nationkey, c_custkey desc limit 1")
def best_ever(t: Tables) -> DataFrame:
    return H.best_ever(t.customer, "c_acctbal", "c_custkey", "c_nationkey")


@query("generation_stats", "select c_nationkey, count(*) as individuals, max(c_acctbal) as best, round(100.0 * count(distinct c_mktsegment) / count(*), 6)::double as diversity, 100.0 * count(distinct c_mktsegment) / count(*) < 10 as reset from customer group by 1")
def generation_stats(t: Tables) -> DataFrame:
    return H.generation_stats(t.customer, "c_nationkey", "c_acctbal", "c_mktsegment", 10.0).withColumn("diversity", F.round("diversity", 6))


@query("generation_times", "select event_type, round(epoch(max(ts)) - epoch(min(ts)), 3) as elapsed from events group by 1")
def generation_times(t: Tables) -> DataFrame:
    return H.generation_stats(t.events, "event_type", "value", "user_id", 10.0, "ts", "ts").select("event_type", F.round("elapsed", 3).alias("elapsed"))


@query("next_id", "select max(o_orderkey) + 1 as next from orders")
def next_id(t: Tables) -> DataFrame:
    return C.next_id(t.orders, "o_orderkey")


@query("evaluate_candidates")
def evaluate_candidates(t: Tables) -> DataFrame:
    done = H.evaluate_candidates(_training(t), "features", "y", [{"regParam": r, "elasticNetParam": e} for r in (0.01, 0.1) for e in (0.0, 0.5)])
    return t.spark.createDataFrame([(c["regParam"], c["elasticNetParam"], m) for c, m in done], "reg double, elastic double, score double")


@query(
    "job_status",
    """select event_id, case when event_id % 6 >= 5 then 'FAILED ALL' when event_type = 'view' and event_id % 2 = 0 then 'FAILED PREVIOUSLY' when event_type = 'view' then 'WAITING'
    when epoch(timestamp '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) > 86400 then 'FAILED' else 'RUNNING' end as status from events""",
)
def job_status(t: Tables) -> DataFrame:
    locked = F.when(F.col("event_type") != "view", F.col("ts"))
    return t.events.select("event_id", H.job_status(locked, F.col("event_id") % 6, F.when(F.col("event_id") % 2 == 0, "error"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 86400, 5).alias("status"))


@query("queue_stats", "select event_type, sum((value < 50 and event_id % 7 <> 0)::int)::bigint as available, sum((value >= 50 and event_id % 7 <> 0)::int)::bigint as locked, sum((event_id % 7 = 0)::int)::bigint as errors, count(*) as total from events group by 1")
def queue_stats(t: Tables) -> DataFrame:
    return H.queue_stats(t.events, "event_type", F.col("value") >= 50, F.col("event_id") % 7 == 0)


@query("progress", "select (select count(*) from labels) as done, count(*) as total, round(100.0 * (select count(*) from labels) / count(*), 2)::double as percent from documents")
def progress(t: Tables) -> DataFrame:
    return H.progress(t.labels, t.documents)


@query(
    "search_report",
    """with r as (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r, count(*) over (partition by c_nationkey) as n from customer)
    select n_name, n as individuals, c_custkey, c_acctbal, r as place from r join nation on c_nationkey = n_nationkey where r <= 3""",
)
def search_report(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    best = t.customer.withColumn("place", place).where("place <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "place")
    head = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("individuals"))
    return best.join(head, "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "individuals", "c_custkey", "c_acctbal", "place")


@query(
    "search_report_lines",
    """with r as (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer)
    select n_nationkey, 'n_name' as section, 0 as place, n_name as entry from nation
    union all select n_nationkey, 'hall', coalesce(r, 0)::int, c_custkey::varchar from nation left join (select * from r where r <= 3) on c_nationkey = n_nationkey
    union all select n.n_nationkey, 'population', (row_number() over (partition by n.n_nationkey order by m.n_nationkey))::int, m.n_name from nation n join nation m on n.n_regionkey = m.n_regionkey""",
)
def search_report_lines(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    best = t.customer.withColumn("place", place).where("place <= 3").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("place", "c_custkey"))).alias("l"))
    nations = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    members = {"hall": ("n_nationkey", best.select("c_nationkey", F.col("l.c_custkey").alias("l"))), "population": ("n_regionkey", nations.select("n_regionkey", F.col("l.n_name").alias("l")))}
    return H.search_report(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", members)


@query("date_reformat", "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as day from orders")
def date_reformat(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.reformat_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd", "dd/MM/yyyy").alias("day"))


@query("date_older", "select l_orderkey, l_linenumber, o_orderdate::date < l_shipdate::date as older from lineitem join orders on l_orderkey = o_orderkey")
def date_older(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", X.is_older(F.col("o_orderdate"), F.col("l_shipdate")).alias("older"))


@query("days_between", "select o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date)::int as days from orders")
def days_between(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.days_between(F.lit("1995-01-01").cast("date"), F.to_date("o_orderdate")).alias("days"))


@query(
    "next_workdays",
    "select o_orderkey, array_to_string(list_transform(list_filter(generate_series(1, 9), lambda k: isodow(o_orderdate::date + k::int) < 6)[1:3], lambda k: strftime(o_orderdate::date + k::int, '%Y-%m-%d')), ',') as days from orders",
)
def next_workdays(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.array_join(F.transform(X.next_workdays(F.to_date("o_orderdate"), 3), lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("days"))


@query("human_bytes", "select doc_id, case when n_chars < 1024 then printf('%.1f', n_chars::double) || 'B' when n_chars < 1048576 then printf('%.1f', n_chars / 1024) || 'KiB' else printf('%.1f', n_chars / 1048576) || 'MiB' end as size from documents")
def human_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.human_bytes(F.col("n_chars")).alias("size"))


@query(
    "duration_words",
    """with m as (select event_id, (event_id * 987654 % 300000000)::bigint as ms from events),
    p as (select event_id, ms, list_filter([(ms // 86400000, 'days'), (ms % 86400000 // 3600000, 'hours'), (ms % 3600000 // 60000, 'minutes'), (ms % 60000 // 1000, 'seconds'), (ms % 1000, 'milliseconds')], lambda x: x[1] > 0) as w from m),
    q as (select event_id, ms, list_transform(w, lambda x: x[1]::bigint || ' ' || x[2]) as w from p)
    select event_id, case when ms <= 0 then 'FINISHED' when len(w) = 1 then w[1] else array_to_string(w[:-2], ' ') || ' and ' || w[-1] end as words from q""",
)
def duration_words(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.duration_words(F.col("event_id") * 987654 % 300000000).alias("words"))


@query("path_name", r"select page_id, regexp_extract(url, '([^/]*)$', 1) as name, regexp_extract(url, '[^/](\.[^./]*)$', 1) as ext, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) as stem, regexp_extract(url, '^(.*)/[^/]*$', 1) as parent from pages where url is not null")
def path_name(t: Tables) -> DataFrame:
    return t.pages.where("url is not null").select("page_id", X.file_name(F.col("url")).alias("name"), X.file_extension(F.col("url")).alias("ext"), X.file_stem(F.col("url")).alias("stem"), X.parent_path(F.col("url")).alias("parent"))


@query("numeric_text", "select event_id, regexp_matches(v, '^[0-9]*[.]?[0-9]*$') and regexp_matches(v, '[0-9]') as numeric from (select event_id, case event_id % 4 when 0 then event_id::varchar when 1 then '-' || event_id when 2 then event_id || '.5' else '1.2.' || event_id end as v from events)")
def numeric_text(t: Tables) -> DataFrame:
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    v = F.when(e % 4 == 0, s).when(e % 4 == 1, F.concat(F.lit("-"), s)).when(e % 4 == 2, F.concat(s, F.lit(".5"))).otherwise(F.concat(F.lit("1.2."), s))
    return t.events.select("event_id", X.is_numeric_text(v).alias("numeric"))


@query("id_year", "select o_orderkey, case when o_orderkey % 3 <> 0 then year(o_orderdate)::int end as year from orders")
def id_year(t: Tables) -> DataFrame:
    v = F.concat(F.when(F.col("o_orderkey") % 3 != 0, "CVE-").otherwise("XCVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", X.id_year(v).alias("year"))


@query("stream_upsert", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def stream_upsert(t: Tables) -> DataFrame:
    from ..streaming.upsert import stream_upsert

    return stream_upsert(t.spark, f"{t.folder}/events.parquet", t.events.schema, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("drop_seen", "select event_id from events where event_id not in (select event_id from events where event_type = 'error')")
def drop_seen(t: Tables) -> DataFrame:
    return C.pending_ids(t.events, t.events.where("event_type = 'error'"), "event_id")
