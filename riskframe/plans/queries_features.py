"""Queries over features, enrichment, statistics and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as K
from ..operators import enrich as E
from ..operators import merge as M
from ..operators import statistics as S
from ..storage import saved
from .registry import Tables, query

#: Stop words of the phrase query.
STOP = ["the", "of", "and", "to", "in", "is", "a", "der", "die", "das", "de", "la", "le", "el", "en"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
#: The token pattern in SQL.
WORD = r"'[\p{L}\p{N}_'']+'"


def doc_triples(t: Tables) -> DataFrame:
    """(entity, feature, value) of documents: language and source one-hot, length, word log; label `exploits_has` from labels."""
    d = t.documents
    triple = lambda name, value: d.select(F.col("doc_id").alias("entity"), name.alias("feature"), value.cast("double").alias("value"))
    parts = [
        triple(F.concat(F.lit("lang_enum_"), "lang"), F.lit(1)), triple(F.concat(F.lit("vendor_enum_"), "source"), F.lit(1)),
        triple(F.lit("n_chars"), F.col("n_chars")), triple(F.lit("description_lines"), F.size(F.split("text", "\n"))),
        t.labels.select(F.col("doc_id").alias("entity"), F.lit("exploits_has").alias("feature"), F.col("toxic").cast("double").alias("value")),
        t.labels.select(F.col("doc_id").alias("entity"), F.lit("quality_flag").alias("feature"), F.col("quality").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("feature is not null and value is not null")


TRIPLES = """triples as (
    select doc_id as entity, 'lang_enum_' || lang as feature, 1.0::double as value from documents where lang is not null
    union all select doc_id, 'vendor_enum_' || source, 1.0 from documents where source is not null
    union all select doc_id, 'n_chars', n_chars::double from documents where n_chars is not null
    union all select doc_id, 'description_lines', (length(text) - length(replace(text, chr(10), '')) + 1)::double from documents where text is not null
    union all select doc_id, 'exploits_has', toxic::double from labels where toxic is not null
    union all select doc_id, 'quality_flag', quality::double from labels where quality is not null)"""
#: Rows with every word of an enumeration, 0 where an entity doesn't have it.
DENSE = """dense as (select * from triples union all select e.entity, f.feature, 0.0::double from (select distinct entity from triples) e, (select distinct feature from triples where contains(feature, '_enum_')) f
        where not exists (select 1 from triples t where t.entity = e.entity and t.feature = f.feature))"""
STATS_OF = """total as (select {total} as total),
    stats as (select feature, count(*) as present, count(distinct value) as n_distinct, min(value) as min, max(value) as max, sum(case when value = 1 then 1 else 0 end)::bigint as ones,
    any_value(total) as total, starts_with(feature, 'vendor_') as is_vendor from dense, total group by feature)"""
STATS = f"{TRIPLES}, {DENSE}, " + STATS_OF.format(total="(select count(distinct doc_id) from documents)")
SCALED = "(min <> max and not (min in (-1, 0, 1) and max in (-1, 0, 1)))"
DROPPED = "(n_distinct <= 1 or present < 0.8 * total)"


def _stats(t: Tables) -> DataFrame:
    return S.analyze(doc_triples(t), S.total_entries(t.documents, "doc_id"), F.startswith(F.col("feature"), F.lit("vendor_")))


@query("vocab", "select 'lang' as field, lang as value from documents union select 'source', source from documents union select 'lang', 'absent' union select 'source', 'absent'")
def vocab(t: Tables) -> DataFrame:
    return X.build_vocab(t.documents, "doc_id", ["lang", "source"])


@query("flatten_unique", "select user_id, count(distinct event_type) as kinds, count(*) as every from events group by 1")
def flatten_unique(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("event_type").alias("every"))


@query(
    "flatten_values",
    """select doc_id, len(string_split(replace(text, chr(10), ' '), ' '))::int as every, len(list_distinct(string_split(replace(text, chr(10), ' '), ' ')))::int as kinds
    from documents where text is not null""",
)
def flatten_values(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return t.documents.where("text is not null").select("doc_id", F.size(X.flatten_values(lines)).alias("every"), F.size(X.flatten_values(lines, unique=True)).alias("kinds"))


@query(
    "one_hot_dense",
    """with v as (select distinct 'lang_enum_' || lower(lang) as feature from documents where lang is not null union select 'lang_enum_absent')
    select doc_id, feature, case when 'lang_enum_' || lower(coalesce(lang, 'absent')) = feature then 1.0 else 0.0 end::double as value from documents, v""",
)
def one_hot_dense(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang")
    return X.one_hot_dense(d, "doc_id", ["lang"], X.build_vocab(d, "doc_id", ["lang"]))


@query("one_hot_sparse", "select doc_id, 'source_enum_' || lower(coalesce(source, 'absent')) as feature, 1.0::double as value from documents union select doc_id, 'lang_enum_' || lower(coalesce(lang, 'absent')), 1.0 from documents")
def one_hot_sparse(t: Tables) -> DataFrame:
    return X.one_hot(t.documents, "doc_id", ["source", "lang"])


@query("recode_absent", "select event_id, case when event_type not in ('error', 'view') then event_type end as kind from events")
def recode_absent(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.recode_absent(F.col("event_type"), ("error", "view")).alias("kind"))


@query("drop_leaky", "select event_id, f as feature from (select event_id, case when event_type = 'error' then 'reference_exploit_db' else 'reference_' || event_type end as f from events) where f not like '%exploit%'")
def drop_leaky(t: Tables) -> DataFrame:
    f = F.when(F.col("event_type") == "error", "reference_exploit_db").otherwise(F.concat(F.lit("reference_"), "event_type"))
    return X.drop_leaky(t.events.select("event_id", f.alias("feature")))


@query("weighted_one_hot", "select user_id, 'module_enum_' || event_type as feature, count(*)::double as value from events group by 1, 2")
def weighted_one_hot(t: Tables) -> DataFrame:
    h = M.type_histogram(t.events, "user_id", F.col("event_type")).select("user_id", F.explode(F.arrays_zip("types", "counts")).alias("z"))
    return h.select("user_id", X.feature_name("module", F.col("z.types")).alias("feature"), F.greatest("z.counts", F.lit(1)).cast("double").alias("value"))


@query(
    "numeric_features",
    """select user_id, count(*) as references_count, greatest(count(distinct event_type), max(event_id % 7)) as versions, coalesce(max(case when event_type = 'error' then value end), 0) as score,
    max(case when event_type = 'error' then 1 else 0 end) as has_score from events group by 1""",
)
def numeric_features(t: Tables) -> DataFrame:
    error = F.max(F.when(F.col("event_type") == "error", F.col("value")))
    e = t.events.groupBy("user_id").agg(F.count("event_type").alias("references_count"), F.countDistinct("event_type").alias("products"), F.max(F.col("event_id") % 7).alias("v"), error.alias("score"))
    counts, larger = {"references_count": F.col("references_count")}, {"versions": (F.col("v"), F.col("products"))}
    values = X.numeric_features(counts, larger, numbers={"score": F.col("score")}, flags={"has_score": F.col("score")})
    return e.select("user_id", *(c.alias(n) for n, c in values.items()))


@query("wc_log", f"select doc_id, round(ln(1 + coalesce(len(regexp_extract_all(text, {WORD})), 0)), 6) as wc from documents")
def wc_log(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.wc_log(F.col("text")), 6).alias("wc"))


@query("token_counts", f"select lower(w) as token, count(*) as n from (select unnest(regexp_extract_all(text, {WORD})) as w from documents) group by 1")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(X.tokens(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("token")).agg(F.count(F.lit(1)).alias("n"))


LEMMA = r"""case when regexp_matches(w, '...ses$') then regexp_replace(w, 'ses$', 's') when regexp_matches(w, '...xes$') then regexp_replace(w, 'xes$', 'x')
    when regexp_matches(w, '...zes$') then regexp_replace(w, 'zes$', 'z') when regexp_matches(w, '...ches$') then regexp_replace(w, 'ches$', 'ch') when regexp_matches(w, '...shes$') then regexp_replace(w, 'shes$', 'sh')
    when regexp_matches(w, '...men$') then regexp_replace(w, 'men$', 'man') when regexp_matches(w, '...ies$') then regexp_replace(w, 'ies$', 'y') when regexp_matches(w, '...ss$') then w when regexp_matches(w, '...us$') then w
    when regexp_matches(w, '...s$') then regexp_replace(w, 's$', '') else w end"""


@query("lemma_rules", f"select w as word, {LEMMA} as lemma from (select distinct lower(unnest(regexp_extract_all(text, {WORD}))) as w from documents)")
def lemma_rules(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(X.tokens(F.lower("text"))).alias("word")).distinct()
    return X.lemmatize(words, "word")


PHRASES = f"""tok as (select doc_id, unnest(regexp_extract_all(lower(text), {WORD})) as w, generate_subscripts(regexp_extract_all(lower(text), {WORD}), 1) as p from documents),
    run as (select *, sum(case when w in ({STOP_SQL}) then 1 else 0 end) over (partition by doc_id order by p) as r from tok),
    phr as (select distinct doc_id, string_agg(w, ' ' order by p) as phrase from run where w not in ({STOP_SQL}) group by doc_id, r having count(*) <= 5)"""


def _phrases(t: Tables) -> DataFrame:
    return X.phrases(t.documents, "doc_id", "text", STOP)


@query("phrases", f"with {PHRASES} select doc_id, phrase from phr")
def phrases(t: Tables) -> DataFrame:
    return _phrases(t)


@query("drop_noise", f"with {PHRASES} select doc_id, phrase from phr where not regexp_matches(phrase, '^(?:th|an|[0-9]+)')")
def drop_noise(t: Tables) -> DataFrame:
    return X.drop_noise(_phrases(t), "phrase", ["th", "an", "[0-9]+"])


@query("doc_frequency", f"with {PHRASES} select phrase, count(*) as df from phr group by 1 having count(*) >= 5")
def doc_frequency(t: Tables) -> DataFrame:
    return X.doc_frequency(_phrases(t), "doc_id", "phrase", 5)


@query("term_frequency", "select doc_id, greatest((length(text) - length(replace(text, 'tion', ''))) // 4, 1) as tf from documents where text is not null")
def term_frequency(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", X.term_frequency(F.col("text"), F.lit("tion")).alias("tf"))


@query(
    "tfidf",
    f"""with {PHRASES}, df as (select phrase, count(*) as df from phr group by 1 having count(*) >= 5)
    select phr.doc_id, phrase, round(greatest((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase), 1) * ln((select count(*) from documents where text is not null)::double / df), 6) as value
    from phr join df using (phrase) join documents d on d.doc_id = phr.doc_id""",
)
def tfidf(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select("doc_id", F.lower("text").alias("low"))
    counts = X.phrase_counts(d, "doc_id", "low", STOP, min_df=5)
    return X.tfidf(counts, "doc_id", "phrase", "tf", d.agg(F.count(F.lit(1)).alias("n"))).withColumn("value", F.round("value", 6))


@query("class_flags", "select event_id::varchar as oval, (event_type = 'purchase')::int as has_patch, (event_type <> 'purchase')::int as has_vuln_oval, case when event_type = 'purchase' then cast(ts as date) end as patch_date, case when event_type <> 'purchase' then cast(ts as date) end as oval_date from events")
def class_flags(t: Tables) -> DataFrame:
    return K.oval_features(_ovals(t)).select("oval", "has_patch", "has_vuln_oval", F.col("patchDate").alias("patch_date"), F.col("ovalDate").alias("oval_date"))


@query("exploit_flags", "select event_id::varchar as exploit, user_id::varchar as cve, strftime(ts, '%d/%m/%Y') as day, (value > 50)::int as verified, 1 as has_exploit from events where event_type = 'error'")
def exploit_flags(t: Tables) -> DataFrame:
    f = K.exploit_features(_exploits(t))
    return f.select("exploit", "cve", F.date_format("exploitDate", "dd/MM/yyyy").alias("day"), F.col("exploit_was_verified").alias("verified"), "has_exploit")


# definitions and exploits of the enrichment queries: events of customers
def _ovals(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").cast("string").alias("oval"), F.concat(F.lit("CVE-"), "user_id").alias("CVE"), F.when(F.col("event_type") == "purchase", "Patch").otherwise("vulnerability").alias("type"), F.to_date("ts").alias("submittedDate")
    )


def _exploits(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'")
    return e.select(F.col("event_id").cast("string").alias("exploit"), F.col("user_id").cast("string").alias("cve"), F.to_date("ts").alias("date"), F.when(F.col("value") > 50, "True").otherwise("False").alias("verified"))


ABSENT = ["phase", "cvss_version", "cvss_av", "cvss_ui", "cvss_s", "type", "cvss_ac", "cvss_aupr", "cvss_c", "cvss_i", "cvss_a", "reference_type", "exploits_weaponized_type"]


PIPE = f"""d as (select 'CVE-' || doc_id as entity, text, lang, source, n_chars from documents where lang is distinct from 'RESERVED'),
    tok as (select entity, {LEMMA} as l, p from (select entity, unnest(regexp_extract_all(text, {WORD})) as w, generate_subscripts(regexp_extract_all(text, {WORD}), 1) as p from d)),
    low as (select entity, string_agg(l, ' ' order by p) as text from tok group by 1),
    run as (select entity, lower(l) as w, p, sum(case when lower(l) in ({STOP_SQL}) then 1 else 0 end) over (partition by entity order by p) as r from tok),
    phr as (select distinct entity, string_agg(w, ' ' order by p) as phrase from run where w not in ({STOP_SQL}) group by entity, r having count(*) <= 5),
    df as (select phrase, count(*) as df from phr group by 1 having count(*) >= 5),
    words as (select entity, 'description_enum_' || replace(phrase, ' ', '_') as feature, greatest((length(text) - length(replace(text, phrase, ''))) // length(phrase), 1) * ln((select count(text) from d)::double / df) as value
        from phr join df using (phrase) join low using (entity)),
    feats as (select entity, 'status_enum_' || lower(coalesce(lang, 'absent')) as feature, 1.0::double as value from d union all select entity, 'vendor_enum_' || replace(lower(coalesce(source, 'absent')), '.', '_'), 1.0 from d
    union all select entity, n || '_enum_absent', 1.0 from d, (select unnest([{", ".join(f"'{n}'" for n in ABSENT)}]) as n)
    union all select entity, n, 0.0 from d, (select unnest(['exploits_weaponized_count', 'references_count', 'products', 'cvss_has_exploitability_score', 'cvss_exploitability_score', 'cvss_has_impact_score', 'cvss_impact_score', 'cpes_non_vulnerable_count']) as n)
    union all select entity, 'comments', coalesce(n_chars % 100, 0) from d union all select entity, 'versions', coalesce(n_chars, 0) from d union all select entity, 'cvss_score', coalesce(n_chars % 10, 0) from d
    union all select entity, feature, value from words)"""


def _records(t: Tables) -> DataFrame:
    """Documents as records, their language as status, their source as vendor."""
    return t.documents.select(
        F.concat(F.lit("CVE-"), "doc_id").alias("cve"), F.col("lang").alias("Status"), F.when(F.col("source").isNotNull(), F.array("source")).alias("vendors"), F.col("text").alias("Description"),
        F.col("n_chars").alias("AffectedVersionsCount"), (F.col("n_chars") % 100).alias("Comments"), (F.col("n_chars") % 10).cast("double").alias("CVSS_score"),
    )


@query("feature_pipeline", f"with {PIPE} select entity, feature, round(value, 6) as value from feats")
def feature_pipeline(t: Tables) -> DataFrame:
    """Record features end to end."""
    return K.cve_features(_records(t), STOP, 5)[0].withColumn("value", F.round("value", 6))


@query("split_labels", f"with {TRIPLES} select entity, feature, value from triples where starts_with(feature, 'exploits_')")
def split_labels(t: Tables) -> DataFrame:
    return E.split_labels(doc_triples(t), "exploits_")[1]


@query("join_exploded_ids", "select l_orderkey, l_linenumber, p_brand, p_size from lineitem join part on l_partkey = p_partkey")
def join_exploded_ids(t: Tables) -> DataFrame:
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    met = E.join_ids(orders.select("l_orderkey", "l", F.col("l.l_partkey").alias("ids")), "l_orderkey", "ids", t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return met.join(orders, "l_orderkey").select("l_orderkey", F.get("l", F.col("pos"))["l_linenumber"].alias("l_linenumber"), "p_brand", "p_size")


@query("two_hop_join", "select c_custkey, count(*) as parts, sum(p_size)::bigint as size from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by 1")
def two_hop_join(t: Tables) -> DataFrame:
    customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("orders")).join(t.customer.select("c_custkey"), "c_custkey")
    middle = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    hops = E.two_hops(customer, "c_custkey", "orders", middle, "l_orderkey", "parts", t.part.select("p_partkey", "p_size"), "p_partkey")
    return hops.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("size"))


@query(
    "enum_fold",
    """select user_id, event_type, list_reduce(list_prepend(0.0::double, list((event_id % 3)::double order by event_id)),
    lambda a, x: case when a = 0 then x when a = 1 and x in (0, 1) then 1.0 else a + x end) as value from events group by 1, 2""",
)
def enum_fold(t: Tables) -> DataFrame:
    return E.enum_fold(t.events.withColumn("v", F.col("event_id") % 3), ["user_id", "event_type"], "event_id", "v")


@query("numeric_fold", "select user_id, event_type, round(sum(value), 4) as value from events group by 1, 2")
def numeric_fold(t: Tables) -> DataFrame:
    return E.numeric_fold(t.events, ["user_id", "event_type"], "value").withColumn("value", F.round("value", 4))


@query("label_any", "select c_custkey, coalesce(max((event_type = 'purchase')::int), 0) as any_purchase, coalesce(max((value > 90)::int), 0) as any_high from customer left join events on c_custkey = user_id group by 1")
def label_any(t: Tables) -> DataFrame:
    return E.label_any(t.customer, "c_custkey", t.events, "user_id", any_purchase=F.col("event_type") == "purchase", any_high=F.col("value") > 90)


@query("earliest_dates", "select user_id, cast(min(ts) filter (event_type = 'view') as date) as first_view, cast(min(ts) filter (event_type = 'click') as date) as first_click from events group by 1")
def earliest_dates(t: Tables) -> DataFrame:
    return E.earliest_dates(t.events.withColumn("day", F.to_date("ts")), "user_id", "event_type", "day", ["view", "click"])


@query("day_deltas", "select l_orderkey, l_linenumber, coalesce(date_diff('day', o_orderdate::date, l_shipdate::date), 0)::int as delta_days_ship from lineitem left join orders on l_orderkey = o_orderkey")
def day_deltas(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in E.day_deltas(F.to_date("o_orderdate"), ship=F.to_date("l_shipdate")).items()))


@query(
    "enrich_full",
    """with r as (select 'CVE-' || c_custkey as entity, c_custkey, date '1995-01-01' + (c_custkey % 1000)::int as published, c_acctbal from customer),
    w as (select o_custkey as c, o_orderkey as k, o_orderdate::date as day, 'cwe_status_enum_' || lower(o_orderstatus) as e, o_totalprice as n from orders),
    a as (select o_custkey as c, l_suppkey % 25 as k, date '1996-01-01' + (l_suppkey % 25)::int as day from orders join lineitem on o_orderkey = l_orderkey),
    o as (select user_id as c, max((event_type = 'purchase')::int) as hp, max((event_type <> 'purchase')::int) as hv, min(case when event_type = 'purchase' then ts::date end) as patch, min(case when event_type <> 'purchase' then ts::date end) as oval from events group by 1),
    x as (select user_id as c, min(ts::date) as day, max((value > 50)::int) as v from events where event_type = 'error' group by 1),
    first as (select entity, published, (select min(day) from w where c = c_custkey) as cwe, (select min(day) from a where c = c_custkey) as capec, o.oval, o.patch, hp, hv, x.day as exploit, x.v from r left join o on o.c = c_custkey left join x on x.c = c_custkey),
    d as (select entity, unnest([('cwe', cwe), ('capec', capec), ('oval', oval), ('patch', patch), ('proposed', published - 5), ('assigned', null)]) as z, published from first)
    select entity, 'balance' as feature, c_acctbal as value from r
    union all select entity, e, 1.0 from r join w on c = c_custkey group by 1, 2
    union all select entity, 'cwe_price', round(sum(n), 2) from r join w on c = c_custkey group by 1
    union all select entity, 'capec_region_enum_' || n_regionkey, 1.0 from r join a on c = c_custkey join nation on n_nationkey = k group by 1, 2
    union all select entity, 'capec_nations', count(*) from r join a on c = c_custkey group by 1
    union all select entity, 'oval_has_patch', hp from first where hp is not null union all select entity, 'oval_has_vuln_oval', hv from first where hv is not null
    union all select entity, 'delta_days_' || z[1], coalesce(date_diff('day', published, z[2]), 0) from d
    union all select entity, 'exploits_has', (exploit is not null)::int from first union all select entity, 'exploits_verified', coalesce(v, 0) from first
    union all select entity, 'exploits_delta_days', coalesce(date_diff('day', published, exploit), 0) from first""",
)
def enrich_full(t: Tables) -> DataFrame:
    """Whole enrichment: customers as records, their orders as weaknesses, the orders' suppliers' nations as attack patterns, events as definitions and exploits."""
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    patterns = t.lineitem.groupBy("l_orderkey").agg(F.collect_list((F.col("l_suppkey") % 25).cast("int")).alias("Related_Attack_Patterns"))
    cwe = t.orders.join(patterns, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("cwe"), "Related_Attack_Patterns", F.to_date("o_orderdate").alias("submittedDate"))
    capec = t.nation.select(F.col("n_nationkey").cast("int").alias("capec"), day("1996-01-01", F.col("n_nationkey")).alias("submittedDate"))
    triple = lambda df, key, *parts: df.select(F.col(key).alias("entity"), F.explode(F.array(*(F.struct(f.alias("feature"), v.cast("double").alias("value")) for f, v in parts))).alias("f")).select("entity", "f.*")
    weak = triple(t.orders, "o_orderkey", (X.feature_name("status", F.col("o_orderstatus")), F.lit(1)), (F.lit("price"), F.col("o_totalprice")))
    attack = triple(t.nation.withColumn("k", F.col("n_nationkey").cast("int")), "k", (X.feature_name("region", F.col("n_regionkey").cast("string")), F.lit(1)), (F.lit("nations"), F.lit(1)))
    ids = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("CWEs"))
    published = day("1995-01-01", F.col("c_custkey") % 1000)
    records = t.customer.join(ids, "c_custkey", "left").select(
        F.concat(F.lit("CVE-"), "c_custkey").alias("cve"), "CWEs", published.alias("published"), F.date_sub(published, 5).alias("proposed"), F.lit(None).cast("date").alias("assigned"), "c_acctbal"
    )
    own = triple(records, "cve", (F.lit("balance"), F.col("c_acctbal")))
    full = K.enrich_data(records, own, cwe, weak, capec, attack, K.oval_features(_ovals(t)), K.exploit_features(_exploits(t)))
    return full.withColumn("value", F.round("value", 2))


@query("semi_labeled", "select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def semi_labeled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query("anti_labeled", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def anti_labeled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("total_entries", "select count(distinct doc_id) as total from documents")
def total_entries(t: Tables) -> DataFrame:
    return S.total_entries(t.documents, "doc_id")


@query("feature_presence", f"with {TRIPLES}, {DENSE} select feature, count(*) as present from dense group by 1")
def feature_presence(t: Tables) -> DataFrame:
    return S.feature_presence(doc_triples(t))


@query("value_histogram", f"with {TRIPLES}, {DENSE} select feature, value, count(*) as n from dense group by 1, 2")
def value_histogram(t: Tables) -> DataFrame:
    return S.value_histogram(doc_triples(t))


@query("feature_range", f"with {STATS} select feature, min, max from stats where not is_vendor")
def feature_range(t: Tables) -> DataFrame:
    return _stats(t).where("not is_vendor").select("feature", "min", "max")


@query("analyze", f"with {STATS} select feature, is_vendor, present, n_distinct, min, max, total, ones from stats")
def analyze(t: Tables) -> DataFrame:
    return _stats(t).select("feature", "is_vendor", "present", "n_distinct", "min", "max", "total", "ones")


@query("needs_scaling", f"with {STATS} select feature from stats where {SCALED}")
def needs_scaling(t: Tables) -> DataFrame:
    return S.needs_scaling(_stats(t)).select("feature")


@query("drop_set", f"with {STATS} select feature from stats where {DROPPED}")
def drop_set(t: Tables) -> DataFrame:
    return S.drop_set(_stats(t)).select("feature")


@query("fill_set", f"with {STATS} select feature from stats where n_distinct > 1 and present >= 0.3 * total and present < total")
def fill_set(t: Tables) -> DataFrame:
    return S.fill_set(_stats(t), 0.3).select("feature")


RARE = "(s.is_vendor and (s.ones < {n} or s.n_distinct <= 1 or s.feature = 'vendor_enum_-'))"
FOLDED = f"""folded as (select entity, feature, max(value) as value from (select t.entity, t.feature, t.value from triples t join stats s using (feature) where not {RARE}
    union all select t.entity, 'vendor_enum_absent', t.value from triples t join stats s using (feature) where {RARE} and t.value = 1) group by 1, 2)"""


@query("fold_rare", f"with {STATS}, {FOLDED.format(n=51)} select * from folded")
def fold_rare(t: Tables) -> DataFrame:
    return S.fold_rare(doc_triples(t), _stats(t), "vendor_enum_absent", 51)


@query("scale_selected", f"with {STATS} select entity, feature, round(case when {SCALED} then (value - min) / (max - min) else value end, 6) as value from triples join stats using (feature)")
def scale_selected(t: Tables) -> DataFrame:
    return S.scale_selected(doc_triples(t), _stats(t)).withColumn("value", F.round("value", 6))


@query(
    "dataset_rows",
    f"""with {TRIPLES} select row_number() over (order by entity) - 1 as index, entity, count(*) filter (feature not like 'exploits_%') as n_features, round(sum(value) filter (feature not like 'exploits_%'), 4) as feature_sum,
    count(*) filter (feature like 'exploits_%') as n_labels from triples group by entity""",
)
def dataset_rows(t: Tables) -> DataFrame:
    d = S.assemble_dataset(doc_triples(t), "exploits_")
    total = F.round(F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, x: a + x), 4)
    return d.select("index", "entity", F.size("features").cast("long").alias("n_features"), total.alias("feature_sum"), F.size("labels").cast("long").alias("n_labels"))


#: Filtered and normalised rows, zeros left out, from stats and folded; {share} is the least share of rows.
NORMALIZED = f"""gone as (select feature from stats where (n_distinct <= 1 or present < {{share}} * total) and not is_vendor),
    normal as (select entity, feature, case when {SCALED} and not is_vendor then (value - min) / (max - min) else value end as value from folded left join stats using (feature) where feature not in (select feature from gone)),
    fill as (select feature from stats where feature not in (select feature from gone) and present < total and not is_vendor and not contains(feature, '_enum_')),
    every as (select entity, feature, value from normal union all select e.entity, fill.feature, 0.0::double from (select distinct entity from triples) e, fill where not exists (select 1 from normal k where k.entity = e.entity and k.feature = fill.feature))"""


@query("normalize_full", f"with {STATS}, {FOLDED.format(n=51)}, {NORMALIZED.format(share=0.3)} select entity, feature, round(value, 6) as value from every")
def normalize_full(t: Tables) -> DataFrame:
    n = S.normalize(doc_triples(t), S.total_entries(t.documents, "doc_id"), F.startswith(F.col("feature"), F.lit("vendor_")), least_share=0.3, least_ones=51)
    return n.withColumn("value", F.round("value", 6))


@query("normalize_default", f"with {STATS}, {FOLDED.format(n=33)}, {NORMALIZED.format(share=0.8)} select entity, feature, round(value, 6) as value from every")
def normalize_default(t: Tables) -> DataFrame:
    """The same with the thresholds that build_dataset has."""
    n = S.normalize(doc_triples(t), S.total_entries(t.documents, "doc_id"), F.startswith(F.col("feature"), F.lit("vendor_")))
    return n.withColumn("value", F.round("value", 6))


#: Statistics and dataset of the record features, from rows with every word of every enumeration.
RECORD_STATS = f"{PIPE}, triples as (select entity, feature, value::double as value from feats), {DENSE}, " + STATS_OF.format(total="(select count(distinct entity) from triples)")


@query("record_statistics", f"with {RECORD_STATS} select feature, present, n_distinct, round(min, 6) as min, round(max, 6) as max, ones from stats")
def record_statistics(t: Tables) -> DataFrame:
    """Statistics of record features that are written sparsely; the SQL counts dense rows."""
    triples = saved(K.cve_features(_records(t), STOP, 5)[0], "triples")  # read by statistics, readers and total
    stats = S.analyze(triples, S.total_entries(triples, "entity"), F.startswith(F.col("feature"), F.lit("vendor_")))
    return stats.select("feature", "present", "n_distinct", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "ones")


@query(
    "build_dataset",
    f"""with {RECORD_STATS}, {FOLDED.format(n=33)}, {NORMALIZED.format(share=0.8)}, place as (select entity, row_number() over (order by entity) - 1 as index from (select distinct entity from every))
    select index, entity, starts_with(feature, 'exploits_') as is_label, feature, round(value, 6) as value from every join place using (entity) where value <> 0""",
)
def build_dataset(t: Tables) -> DataFrame:
    """Records to dataset rows at the default thresholds; values other than 0."""
    data = K.build_dataset(K.cve_features(_records(t), STOP, 5)[0])
    part = lambda name, label: data.select("index", "entity", F.lit(label).alias("is_label"), F.explode(name).alias("feature", "value"))
    return part("features", False).unionByName(part("labels", True)).where("value <> 0").withColumn("value", F.round("value", 6))


@query(
    "feature_groups",
    f"""with {TRIPLES}, g as (select distinct feature, case when starts_with(feature, 'lang_') then 1 when starts_with(feature, 'description_') then 2 when starts_with(feature, 'reference_') then 3 when starts_with(feature, 'vendor_') then 4 else 0 end as grp from triples)
    select grp, count(*) as n from g group by rollup (grp)""",
)
def feature_groups(t: Tables) -> DataFrame:
    return doc_triples(t).select("feature").distinct().rollup(S.feature_group(F.col("feature")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_balance",
    """select source as grp, sum(coalesce((toxic = 0)::int, 0))::bigint as negative, sum(coalesce((toxic = 1)::int, 0))::bigint as positive, round(100.0 * sum((toxic = 1)::int) / nullif(sum((toxic in (0, 1))::int), 0), 2)::double as positive_percent
    from (select case when doc_id in (select doc_id from labels where toxic is not null) then source else 'unlabelled ' || source end as source, toxic from documents left join labels using (doc_id)) group by rollup (source)""",
)
def class_balance(t: Tables) -> DataFrame:
    """Documents without a label are groups of their own, which have neither class."""
    source = F.when(F.col("toxic").isNotNull(), F.col("source")).otherwise(F.concat(F.lit("unlabelled "), "source"))
    return S.class_balance(t.documents.join(t.labels, "doc_id", "left").withColumn("source", source), "source", "toxic")


@query("nan_mean", "select event_type, round(avg(case when value > 50 then value end), 6) as mean from events group by 1")
def nan_mean(t: Tables) -> DataFrame:
    e = t.events.withColumn("v", F.when(F.col("value") > 50, F.col("value")).otherwise(F.lit(float("nan"))))
    return e.groupBy("event_type").agg(F.round(S.nan_mean("v"), 6).alias("mean"))
