"""Readers and flatteners on hand-made files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from riskframe.operators import collections as C
from riskframe.operators import merge as M
from riskframe.sources import csv, feeds, html


def test_preamble_csv(spark, tmp_path):
    lines = ["CVE Version 20061101", "Date: 20240131", "Name,Status,Description", *["x"] * 7, 'CVE-1,Entry,"a, b"', "CVE-2,Candidate"]
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    rows, head = csv.read_preamble_csv(spark, str(tmp_path / "m.csv.gz"))
    assert sorted(map(tuple, rows.collect())) == [("CVE-1", "Entry", "a, b"), ("CVE-2", "Candidate", None)]
    assert head == {"version": "20061101", "date": "20240131"}
    # data that say what a head row says, a row wider than the header, a line end inside quotes
    lines = ["v 1", "d 2", "Name,Status", *["", "x", "", "x", "", "x", "x"], "x,1", "Name,2", '"a\nb",3,4,5', "y"]
    (tmp_path / "w.csv").write_text("\n".join(lines))
    rows, _ = csv.read_preamble_csv(spark, str(tmp_path / "w.csv"))
    assert rows.columns == ["Name", "Status", "column_2", "column_3"]
    assert list(map(tuple, rows.collect())) == [("x", "1", None, None), ("Name", "2", None, None), ("a\nb", "3", "4", "5"), ("y", None, None, None)]


def test_dense_row_numbers_of_a_million_rows(spark):
    df = spark.range(1_200_000).select((F.col("id") * 7919 % 1_200_007).alias("k"), F.repeat(F.lit("x"), 20).alias("payload"))
    r = C.with_index(df, "at", "k").agg(F.countDistinct("at"), F.min("at"), F.max("at"), F.count("payload")).first()
    assert tuple(r) == (1_200_000, 0, 1_199_999, 1_200_000)


def test_labeled_csv(spark, tmp_path):
    (tmp_path / "i.csv").write_text("1,2,a\n3,4,b\n")
    assert sorted(map(tuple, csv.read_labeled_csv(spark, str(tmp_path / "i.csv")).collect())) == [([1.0, 2.0], "a"), ([3.0, 4.0], "b")]


def item(key, v2=True, v3=True):
    impact = {}
    if v2:
        impact["baseMetricV2"] = {"cvssV2": {"version": "2.0", "baseScore": 5.0, "accessVector": "LOCAL"}, "impactScore": 1.0}
    if v3:
        impact["baseMetricV3"] = {"cvssV3": {"version": "3.1", "baseScore": 9.8, "attackVector": "NETWORK"}}
    return {
        "cve": {
            "CVE_data_meta": {"ID": key} if key else {}, "problemtype": {"problemtype_data": [{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}]}]},
            "references": {"reference_data": [{"url": "http://a", "tags": []}, {"url": "http://b", "tags": ["Patch"]}]}, "description": {"description_data": [{"value": "text"}]},
        },
        "configurations": {"nodes": [{"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:2.3:a:Acme:Tool:1"}], "children": [{"cpe_match": [{"vulnerable": False, "cpe23Uri": "cpe:2.3:o:*:os:2"}]}]}, {}]},
        "impact": impact, "publishedDate": "2020-01-31T10:00Z", "lastModifiedDate": "2020-02-01T10:00Z",
    }


def test_json_feed(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"CVE_data_version": "4", "CVE_Items": [item("CVE-1"), item("CVE-2", v3=False)]}))
    df = feeds.read_json_feed(spark, str(tmp_path / "f.json"))
    hit, other = M.explode_cpes(F.col("nodes"))
    vendor, product = M.cpe_names(F.concat(hit, other))
    got = df.select("cve", "published", F.col("references")[0]["tags"].alias("t"), M.numeric_ids(F.col("problems"), "CWE").alias("w"), hit.alias("hit"), vendor.alias("v"), product.alias("p"), *(c.alias(n) for n, c in feeds.severity().items())).orderBy("cve").collect()
    assert [r.cve for r in got] == ["CVE-1", "CVE-2"] and got[0].t is None and got[0].w == ["79"] and str(got[0].published) == "2020-01-31"
    assert got[0].hit == ["cpe:2.3:a:Acme:Tool:1"] and got[0].v == ["acme"] and got[0].p == ["tool", "os"]
    assert (got[0].CVSS_score, got[0].CVSS_impactScore, got[1].CVSS_score, got[1].CVSS_AV) == (9.8, 1.0, 5.0, "LOCAL")
    (tmp_path / "g.json").write_text(json.dumps({"CVE_Items": [item(None)]}))
    with pytest.raises(Exception, match="no id"):
        feeds.read_json_feed(spark, str(tmp_path / "g.json")).collect()


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<C xmlns:x='u'><Weakness ID='79' Name='n'><x:Scope>A</x:Scope><Scope>B</Scope></Weakness><Weakness ID='80'><Scope>A</Scope></Weakness></C>")
    df = feeds.read_xml_catalog(spark, str(tmp_path / "c.xml"), "Weakness", "cwe", "_ID string, _Name string, Scope array<string>")
    assert sorted((r.cwe, r.Scope) for r in df.collect()) == [("79", ["A", "B"]), ("80", ["A"])]
    one = '<definition id="oval:org:def:{n}" class="patch"><metadata><title>t</title><reference source="CVE" ref_id="CVE-1"/><reference source="VENDOR" ref_id="z"/><oval_repository><dates><submitted date="2010-01-02T00:00"/><modified date="2011-01-01T00:00"/><modified date="2012-03-04T00:00"/><status_change date="2013">{s}</status_change></dates></oval_repository></metadata></definition>'
    (tmp_path / "o.xml").write_text("<d>" + one.format(n=1, s="ACCEPTED") + one.format(n=2, s="DEPRECATED") + "</d>")
    got = M.flatten_oval(feeds.read_oval(spark, str(tmp_path / "o.xml"))).collect()
    assert [(r.oval, r.CVE, r.type, str(r.submittedDate), str(r.modifiedDate)) for r in got] == [("1", "CVE-1", "patch", "2010-01-02", "2012-03-04")]


def test_html_tables(spark):
    page = "<table><tr><th>#</th><th>Vendor</th><th>Name</th></tr><tr><td>1</td><td><b>a</b></td><td>nan</td></tr><tr><td>2</td><td>b</td><td>x</td></tr></table>"
    got = html.extract_tables(spark.createDataFrame([(1, page), (2, "none")], "id long, html string"), "id", "html").collect()
    assert [(r.id, r.row_no, r.cells) for r in got] == [(1, 0, {"Vendor": "a"}), (1, 1, {"Vendor": "b", "Name": "x"})]


def test_clean_nested(spark):
    df = spark.createDataFrame([(1, ("x", None, ["", "a"])), (2, (None, "b", [""]))], "id int, s struct<v: string, br: string, l: array<string>>")
    got = {r.id: r.s for r in feeds.clean_nested(df).collect()}
    assert got[1].asDict() == {"v": "x", "l": ["a"]} and got[2] is None


def test_export_import(spark, tmp_path):
    t = spark.createDataFrame([(1, [1, 2]), (2, None)], "id long, v array<int>")
    C.export_tables({"t": (t, "id")}, str(tmp_path / "x"))
    back, key = C.import_tables(spark, str(tmp_path / "x"))["t"]
    assert key == "id" and back.schema == t.schema and sorted(map(tuple, back.collect())) == [(1, [1, 2]), (2, None)]


def test_flatness_phase_and_checks(spark):
    M.assert_flat(spark.createDataFrame([], "a int, b array<string>, c array<array<string>>").schema, ("c",))
    with pytest.raises(ValueError):
        M.assert_flat(spark.createDataFrame([], "a struct<b: int>").schema)
    r = spark.createDataFrame([("Assigned (20200131)",), (None,)], "p string").select(*(c.alias(n) for n, c in M.phase_dates("p").items())).collect()
    assert r[0].phase == "Assigned" and str(r[0].assigned) == "2020-01-31" and r[1].phase is None
    with pytest.raises(ValueError):
        C.require_tables({"a": None}, ["a"])


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")], "k int, o int, v string")
    new = spark.createDataFrame([(2, 2, "B"), (3, 1, "c")], "k int, o int, v string")
    once = C.upsert(old, new, "k", "o")
    want = [("1", "a"), ("2", "B"), ("3", "c"), ("None", "n")]
    assert sorted((str(r.k), r.v) for r in once.collect()) == want
    assert sorted((str(r.k), r.v) for r in C.upsert(once.where("k is not null"), new, "k", "o").collect()) == want[:3]


def test_stream_takes_only_new_files(spark, tmp_path):
    from riskframe.streaming.upsert import stream_upsert

    schema = spark.createDataFrame([], "k long, o long, v string").schema
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 1, "a"), (2, 1, "b"), (1, 0, "old")])
    run = lambda: sorted(map(tuple, stream_upsert(spark, str(tmp_path / "in"), schema, "k", "o", str(tmp_path / "t")).collect()))
    assert run() == [(1, 1, "a"), (2, 1, "b")]
    put([(2, 5, "B"), (3, 1, "c")])
    assert run() == [(1, 1, "a"), (2, 5, "B"), (3, 1, "c")]
    assert run() == [(1, 1, "a"), (2, 5, "B"), (3, 1, "c")]  # no new file
    put([(4, 1, "d")])
    assert run() == [(1, 1, "a"), (2, 5, "B"), (3, 1, "c"), (4, 1, "d")]


def test_detail_record(spark):
    page = """<h1>Vulnerability Details : <a href="/x">CVE-2020-1</a></h1><table>
      <tr><th>CVSS Score</th><td><div class="cvssbox">7.5</div></td></tr><tr><th>Confidentiality Impact</th><td><span>Partial</span></td></tr><tr><th>Integrity Impact</th><td>None</td></tr>
      <tr><th>Availability Impact</th><td>Complete</td></tr><tr><th>Access Complexity</th><td>Low</td></tr><tr><th>Authentication</th><td>Not required</td></tr><tr><th>Gained Access</th><td>Admin</td></tr>
      <tr><th>Vulnerability Type(s)</th><td><span class="vt_overflow">Overflow</span></td></tr><tr><th>CWE ID</th><td>79</td></tr></table>
      <div class="cvedetailssummary">
        A heap <b>overflow</b>.<br>More.
        <span class="datenote">Publish Date : 2020-01-02 Last Update Date : 2020-03-04</span></div>
      <h2>Products Affected By CVE-2020-1</h2><table class=l><tr><th>#</th><th>Vendor</th><th>Product</th></tr><tr><td>1</td><td>Acme</td><td>nan</td></tr></table>
      <h2>Number Of Affected Versions By Product</h2><table><tr><th>Vendor</th><th>Vulnerable Versions</th></tr><tr><td>Acme&nbsp;</td><td>3</td></tr></table>
      <h2>References For CVE-2020-1</h2><table><tr><td><a href=u>http://u</a> CONFIRM</td></tr><tr><td>http://v</td></tr></table>
      <h2>Metasploit Modules Related To CVE-2020-1</h2><div id="metasploitmodstable"><table><tr><th>Module</th></tr><tr><td>m1</td></tr></table></div>"""
    rows = [(1, page), (2, "<strong>Unknown CVE ID</strong>" + page), (3, "<p>nothing</p>"), (4, None), (5, "<th>CWE ID</th><td>CWE id is not defined for this vulnerability</td><th>CVSS Score</th> <td>0.0</td>")]
    got = {r.id: r.detail for r in html.detail_record(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert set(got) == {1, 5} and got[5]["cvss score"] == "0.0" and got[5]["cwe"] is None
    d = got[1].asDict()
    assert [d[k] for k in ("cve", "cvss score", "confidentiality imp.", "integrity imp.", "availability imp.", "complexity", "authentication", "gained acc.", "vul. type", "cwe")] == ["CVE-2020-1", "7.5", "Partial", None, "Complete", "Low", "Not required", "Admin", "Overflow - vt_overflow", "79"]
    assert d["description"] == "A heap overflow.\nMore." and (d["publish date"], d["last mod date"]) == ("2020-01-02", "2020-03-04")
    assert d["prod. affected"] == [{"Vendor": "Acme"}] and d["versions affected"] == [{"Vendor": "Acme", "Vulnerable Versions": "3"}] and d["references"] == ["http://u", "http://v"] and d["metasploitable"] == [{"Module": "m1"}]


def test_patterns_and_nested_lists(spark, tmp_path):
    from riskframe.functions import text as X

    (tmp_path / "noise.txt").write_text("# noise of records\n^[0-9\\s]*$\n\n^cvss [0-9]*$\n^ha$\n")
    patterns = X.read_patterns(spark, str(tmp_path / "noise.txt"))
    assert patterns == ["^[0-9\\s]*$", "^cvss [0-9]*$", "^ha$"]
    df = spark.createDataFrame([("12 3",), ("cvss 20",), ("hat",), ("ha",)], "p string")
    assert [r.p for r in X.drop_noise(df, "p", patterns).collect()] == ["hat"]
    df = spark.createDataFrame([(1, [["a b", "c"], None, ["c"]]), (2, None)], "k int, l array<array<string>>")
    assert sorted(map(tuple, X.build_vocab(df, "k", ["l"]).collect())) == [("l", "a_b"), ("l", "absent"), ("l", "c")]
    assert sorted((r.k, r.feature) for r in X.one_hot(df, "k", ["l"]).collect()) == [(1, "l_enum_a_b"), (1, "l_enum_c"), (2, "l_enum_absent")]
