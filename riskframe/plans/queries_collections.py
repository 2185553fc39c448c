"""Queries over scans, merging and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import collections as C
from ..operators import merge as M
from ..sources import html as H
from .registry import Tables, query


@query("ragged_width", "select max(length(regexp_replace(text, '\"[^\"]*\"', '', 'g')) - length(replace(regexp_replace(text, '\"[^\"]*\"', '', 'g'), ',', '')) + 1) as width from documents where text is not null")
def ragged_width(t: Tables) -> DataFrame:
    from ..sources.csv import ragged_width

    return ragged_width(t.documents, "text", ",")


@query("json_props", "select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("membership_attach", "select n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def membership_attach(t: Tables) -> DataFrame:
    groups = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("members")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return C.attach_membership(t.nation, groups, "n_nationkey", "members", "r_regionkey", "grp").select("n_name", "grp.r_name")


@query(
    "resolve_refs",
    """select l_orderkey, string_agg(p_name, '|' order by l_linenumber, l_partkey) as names
    from lineitem join part on l_partkey = p_partkey where l_orderkey is not null group by 1""",
)
def resolve_refs(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    ids = ids.select("l_orderkey", F.col("l.l_partkey").alias("parts"))
    met = C.resolve_refs(ids, t.part.select("p_partkey", "p_name"), "l_orderkey", "parts", "p_partkey", "refs")
    return met.select("l_orderkey", F.array_join(F.col("refs.p_name"), "|").alias("names"))


@query(
    "html_fields",
    r"""select page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '', 'g')), '') as title,
    nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), '') as heading,
    list_extract(regexp_extract_all(html, 'href="([^"]*)"', 1), -1) as last_link
    from pages where regexp_matches(html, '<title>|<h1|href="')""",
)
def html_fields(t: Tables) -> DataFrame:
    return H.extract_fields(
        t.pages, "html", {"title": "<title>([^<]*)</title>", "heading": "<h1[^>]*>([^<]*)</h1>"}, {"last_link": 'href="([^"]*)"'}
    ).select("page_id", "title", "heading", "last_link")


@query(
    "html_detail",
    r"""select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title, (length(html) - length(replace(html, '<p', ''))) // 2 as paragraphs,
    regexp_extract(url, '://([^/?#]*)', 1) || ' - ' || coalesce(nullif(regexp_extract(url, '://[^/]*/([a-z]+)/', 1), ''), 'none') as kind
    from pages where html like '%<body%'""",
)
def html_detail(t: Tables) -> DataFrame:
    return H.detail_page(t.pages)


@query(
    "html_list_rows",
    r"""select page_id, row_no - 1 as row_no, link from (
    select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as link,
    generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) as row_no from pages)""",
)
def html_list_rows(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(F.expr("""regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)""")).alias("row_no", "link"))


# pages that describe parts as records of vulnerabilities, with their suppliers' lines as a table
def _detail_pages(t: Tables) -> DataFrame:
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}</th>\n<td>"), value, F.lit("</td></tr>"))
    text = F.concat(F.lit('<div class="cvedetailssummary">\n'), "p_name", F.lit("<br>of "), "p_brand", F.lit(' <span class="datenote">Publish Date : 19'), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-01-31 Last Update Date : 2001-02-03</span></div>"))
    lines = t.lineitem.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("l"))
    table = F.concat(
        F.lit("<h2>Products Affected By CVE-1</h2> <table id=x><tr><th>#</th><th>Vendor</th><th>Count</th></tr>"),
        F.array_join(F.transform("l", lambda x: F.concat(F.lit("<tr><td>1</td><td><a>"), x["l_orderkey"], F.lit("</a></td><td>"), F.when(x["l_quantity"] > 25, F.lit("nan")).otherwise(x["l_linenumber"].cast("string")), F.lit("</td></tr>"))), "\n"), F.lit("</table>"),
    )
    html = F.concat(
        F.lit("<h1>Vulnerability Details : <a href=x>CVE-"), "p_partkey", F.lit("</a></h1><table>"), row("CVSS Score", F.concat(F.lit('<div class="s">'), "p_size")), row("CWE ID", F.when(F.col("p_size") > 40, "CWE id is not defined for this vulnerability").otherwise(F.col("p_size").cast("string"))),
        row("Vulnerability Type(s)", F.concat(F.lit('<span class="vt_'), "p_size", F.lit('">'), "p_brand", F.lit("</span>"))), F.lit("</table>"), text, F.coalesce(table, F.lit("")),
    )
    unknown = F.when(F.col("p_partkey") % 10 == 0, F.lit("<strong>Unknown CVE ID</strong>")).otherwise(html)
    return t.part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", unknown.alias("html"))


@query(
    "detail_record",
    """with l as (select l_partkey, count(*) as n, string_agg(l_orderkey || ':' || case when l_quantity > 25 then '' else l_linenumber::varchar end, ',' order by l_orderkey, l_linenumber, l_quantity) as products from lineitem group by 1)
    select p_partkey, 'CVE-' || p_partkey as cve, p_size::varchar as score, case when p_size <= 40 then p_size::varchar end as cwe, p_brand || ' - vt_' || p_size as type, p_name || chr(10) || 'of ' || p_brand as description,
    '19' || lpad((p_partkey % 100)::varchar, 2, '0') || '-01-31' as published, '2001-02-03' as modified, products from part left join l on l_partkey = p_partkey where p_partkey % 10 <> 0""",
)
def detail_record(t: Tables) -> DataFrame:
    """Pages of records read back as structs."""
    d = lambda name: F.col("detail").getField(name)
    products = F.array_join(F.transform(d("prod. affected"), lambda m: F.concat(m["Vendor"], F.lit(":"), F.coalesce(F.try_element_at(m, F.lit("Count")), F.lit("")))), ",")
    return H.detail_record(_detail_pages(t)).select(
        "p_partkey", d("cve").alias("cve"), d("cvss score").alias("score"), d("cwe").alias("cwe"), d("vul. type").alias("type"), d("description").alias("description"), d("publish date").alias("published"),
        d("last mod date").alias("modified"), products.alias("products"),
    )


@query(
    "html_tables",
    """select p_partkey, row_number() over (partition by p_partkey order by l_orderkey, l_linenumber, l_quantity) - 1 as row_no, l_orderkey::varchar as vendor, case when l_quantity <= 25 then l_linenumber::varchar end as n
    from part join lineitem on l_partkey = p_partkey where p_partkey % 10 <> 0""",
)
def html_tables(t: Tables) -> DataFrame:
    """Rows of the tables of products on those pages."""
    table = F.regexp_extract("html", "(?s)<table id=x>.*</table>", 0)
    rows = H.extract_tables(_detail_pages(t).withColumn("table", table), "p_partkey", "table")
    return rows.select("p_partkey", F.col("row_no").cast("long").alias("row_no"), F.col("cells")["Vendor"].alias("vendor"), F.try_element_at("cells", F.lit("Count")).alias("n"))


@query("source_metadata", "select source, count(*) as data_count, max(n_chars) as longest, count(distinct lang) as languages from documents group by 1")
def source_metadata(t: Tables) -> DataFrame:
    return C.source_metadata(t.documents, "source", longest=F.max("n_chars"), languages=F.countDistinct("lang"))


@query("upsert_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def upsert_latest(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    return C.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query(
    "registry_union",
    """select distinct family, id from (select 'customer' as family, cast(c_custkey as varchar) as id from customer union all select 'customer', cast(o_custkey as varchar) from orders
    union all select 'part', cast(p_partkey as varchar) from part union all select 'part', cast(l_partkey as varchar) from lineitem) where id is not null""",
)
def registry_union(t: Tables) -> DataFrame:
    return C.registry(("customer", t.customer, "c_custkey"), ("customer", t.orders, "o_custkey"), ("part", t.part, "p_partkey"), ("part", t.lineitem, "l_partkey"))


@query("find_one", "select c_custkey, c_name, c_mktsegment from customer where c_custkey = 42 limit 1")
def find_one(t: Tables) -> DataFrame:
    return C.find_one(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 42)


@query("find_project_sort_limit", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 100")
def find_project_sort_limit(t: Tables) -> DataFrame:
    return C.find(t.orders, F.col("o_orderstatus") == "F", ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), "o_orderkey"], 100)


@query(
    "update_set_push",
    """select o_orderkey, case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus,
    case when o_totalprice > 200000 then o_orderpriority || ',large' else o_orderpriority end as tags from orders""",
)
def update_set_push(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.array("o_orderpriority").alias("tags"))
    new = C.update(o, F.col("o_totalprice") > 200000, {"o_orderstatus": F.lit("X")}, {"tags": F.lit("large")})
    return new.select("o_orderkey", "o_orderstatus", F.array_join("tags", ",").alias("tags"))


@query("claim_unstarted", "select event_id, case when event_type = 'error' and value < 50 then 'now' when value >= 50 then 'before' end as started_at from events")
def claim_unstarted(t: Tables) -> DataFrame:
    e = t.events.withColumn("started_at", F.when(F.col("value") >= 50, "before"))
    return C.claim(e, F.col("event_type") == "error", F.lit("now")).select("event_id", "started_at")


@query("delete_key", "select c_custkey, c_name from customer where c_custkey <> 7")
def delete_key(t: Tables) -> DataFrame:
    return C.delete_by_key(t.customer.select("c_custkey", "c_name"), "c_custkey", 7)


@query("pending_ids", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 300000)")
def pending_ids(t: Tables) -> DataFrame:
    return C.pending_ids(t.customer, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "merge_sources",
    """with ids as (select c_custkey as id from customer union select s_suppkey from supplier union select o_custkey from orders),
    o as (select o_custkey as id, max(o_totalprice) as balance from orders group by 1)
    select ids.id, coalesce(s_acctbal, o.balance, c_acctbal) as balance, c_name as name_customer, s_name as name_supplier
    from ids left join customer on ids.id = c_custkey left join o on ids.id = o.id left join supplier on ids.id = s_suppkey
    where c_custkey is not null or o.id is not null or s_suppkey is not null""",
)
def merge_sources(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    ids = c.select("id").union(o.select("id")).union(s.select("id"))
    return M.merge_sources(ids, {"customer": c, "orders": o, "supplier": s}, "id", ("name",)).select("id", "balance", "name_customer", "name_supplier")


@query(
    "merge_references",
    """with e as (select page_id % 50 as id, trim(regexp_replace(url, '[?#].*$', '')) as url, page_id as p, case when page_id % 3 = 0 then 'URL' when page_id % 3 = 1 then 'en' else 'xx' end as tag from pages where url is not null),
    g as (select id, url, min(p) as p, list_sort(list_distinct(list(tag))) as tags from e group by 1, 2)
    select id, url, array_to_string(case when len(tags) > 1 then list_filter(tags, lambda x: x <> 'URL') else tags end, ',') as tags from g""",
)
def merge_references(t: Tables) -> DataFrame:
    tag = F.when(F.col("page_id") % 3 == 0, "URL").when(F.col("page_id") % 3 == 1, "en").otherwise("xx")
    entry = F.struct(F.regexp_replace("url", "[?#].*$", "").alias("url"), F.array(tag).alias("tags"))
    p = t.pages.where("url is not null")
    lists = p.groupBy((F.col("page_id") % 50).alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("page_id") % 2 == 0, entry))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("page_id") % 2 == 1, entry))).alias("b")
    )
    return M.merge_references(lists, "id", "a", "b").select("id", "url", F.array_join("tags", ",").alias("tags"))


@query(
    "merge_text",
    "select c_custkey, case when trim(c_mktsegment) = trim(c_name) then trim(c_name) else trim(c_name) || chr(10) || trim(c_mktsegment) end as text from customer where c_name <> '' and c_mktsegment <> ''",
)
def merge_text(t: Tables) -> DataFrame:
    return t.customer.where("c_name <> '' and c_mktsegment <> ''").select("c_custkey", M.merge_text(F.col("c_name"), F.col("c_mktsegment"), F.concat(F.col("c_name"), F.lit(" "))).alias("text"))


@query("filter_marker", "select doc_id, n_chars from documents where text is null or not contains(text, 'License')")
def filter_marker(t: Tables) -> DataFrame:
    return M.drop_reserved(t.documents, "text", "License").select("doc_id", "n_chars")


@query(
    "nested_ids",
    "select user_id, array_to_string(list_sort(list_distinct(list(event_id % 20))), ',') as ids from events group by 1",
)
def nested_ids(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.collect_set(F.concat(F.lit("CWE-"), F.col("event_id") % 20)).alias("v"))
    ids = F.array_sort(F.transform(M.numeric_ids(F.concat("v", F.array(F.lit("CWE-x"))), "CWE"), lambda x: x.cast("long")))
    return e.select("user_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "path_parts",
    "select page_id, lower(split_part(replace(url, '/', ':'), ':', 4)) as vendor, lower(split_part(replace(url, '/', ':'), ':', 5)) as product from pages where url is not null",
)
def path_parts(t: Tables) -> DataFrame:
    vendor, product = M.cpe_names(F.array(F.translate("url", "/", ":")))
    return t.pages.where("url is not null").select("page_id", F.coalesce(F.get(vendor, F.lit(0)), F.lit("*")).alias("vendor"), F.coalesce(F.get(product, F.lit(0)), F.lit("*")).alias("product"))


@query("array_sum", "select l_orderkey, sum(l_linenumber)::bigint as versions, count(distinct l_suppkey) as vendors from lineitem group by 1")
def array_sum(t: Tables) -> DataFrame:
    l = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("v"), F.collect_set("l_suppkey").alias("s"))
    return l.select("l_orderkey", M.sum_versions(F.col("v")).alias("versions"), F.size(F.array_union("s", "s")).cast("long").alias("vendors"))


@query(
    "coalesce_upper",
    "select o_orderkey, coalesce(case when o_orderstatus = 'F' then 'F' end, upper(replace(case when o_orderpriority = '5-LOW' then 'Not required' else o_orderpriority end, 'Not required', 'NONE'))) as v from orders",
)
def coalesce_upper(t: Tables) -> DataFrame:
    other = F.when(F.col("o_orderpriority") == "5-LOW", "Not required").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", M.coalesce_upper(F.when(F.col("o_orderstatus") == "F", "F"), other).alias("v"))


@query("split_first", "select o_orderkey, case when instr(o_orderpriority, '-') > 0 then trim(substr(o_orderpriority, instr(o_orderpriority, '-') + 1)) else trim(o_orderpriority) end as v from orders")
def split_first(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.after_first(F.col("o_orderpriority")).alias("v"))


@query("date_extremes", "select l_orderkey, l_linenumber, cast(least(o_orderdate, l_shipdate) as date) as published, cast(greatest(o_orderdate, l_shipdate) as date) as modified from lineitem join orders on l_orderkey = o_orderkey")
def date_extremes(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = [F.col("o_orderdate"), F.col("l_shipdate")]
    days = M.date_extremes(both, both)
    return j.select("l_orderkey", "l_linenumber", days["publishedDate"].alias("published"), days["lastModifiedDate"].alias("modified"))


@query(
    "type_histogram",
    """with n as (select user_id, case when event_type = 'view' then 'other' else event_type end as kind, count(*) as n from events group by 1, 2)
    select user_id, string_agg(kind, ',' order by kind) as types, string_agg(cast(n as varchar), ',' order by kind) as counts from n group by 1""",
)
def type_histogram(t: Tables) -> DataFrame:
    h = M.type_histogram(t.events, "user_id", F.nullif(F.col("event_type"), F.lit("view")))
    return h.select("user_id", F.array_join("types", ",").alias("types"), F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("count_parts", "select doc_id, case when text is null then 0 else length(text) - length(replace(text, '|', '')) + 1 end::bigint as parts from documents")
def count_parts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.count_parts(F.col("text")).cast("long").alias("parts"))


@query(
    "pivot_relations",
    """select o_custkey, coalesce(string_agg(distinct o_orderpriority, ',' order by o_orderpriority) filter (o_orderstatus = 'F'), '') as f,
    coalesce(string_agg(distinct o_orderpriority, ',' order by o_orderpriority) filter (o_orderstatus = 'O'), '') as o from orders group by 1""",
)
def pivot_relations(t: Tables) -> DataFrame:
    p = M.pivot_relations(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority", ["F", "O"])
    return p.select("o_custkey", F.array_join(F.coalesce("F", F.array()), ",").alias("f"), F.array_join(F.coalesce("O", F.array()), ",").alias("o"))


@query("filter_not_null", "select doc_id, toxic from labels where toxic is not null and doc_id is not null")
def filter_not_null(t: Tables) -> DataFrame:
    return C.find(t.labels, F.col("toxic").isNotNull() & F.col("doc_id").isNotNull(), ["doc_id", "toxic"])
