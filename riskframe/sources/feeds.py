"""Raw feeds: nested JSON records and XML catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shape of a record feed file: one object with a list of items.
JSON_FEED = """CVE_data_version string, CVE_data_timestamp string, CVE_Items array<struct<
  cve: struct<CVE_data_meta: struct<ID: string>,
    problemtype: struct<problemtype_data: array<struct<description: array<struct<value: string>>>>>,
    references: struct<reference_data: array<struct<url: string, tags: array<string>>>>,
    description: struct<description_data: array<struct<value: string>>>>,
  configurations: struct<nodes: array<struct<cpe_match: array<struct<vulnerable: boolean, cpe23Uri: string>>, children: array<struct<cpe_match: array<struct<vulnerable: boolean, cpe23Uri: string>>>>>>>,
  impact: struct<
    baseMetricV2: struct<cvssV2: struct<version: string, vectorString: string, baseScore: double, accessVector: string, accessComplexity: string, authentication: string,
      confidentialityImpact: string, integrityImpact: string, availabilityImpact: string>, severity: string, exploitabilityScore: double, impactScore: double>,
    baseMetricV3: struct<cvssV3: struct<version: string, vectorString: string, baseScore: double, baseSeverity: string, attackVector: string, attackComplexity: string, privilegesRequired: string,
      userInteraction: string, scope: string, confidentialityImpact: string, integrityImpact: string, availabilityImpact: string>, exploitabilityScore: double, impactScore: double>>,
  publishedDate: string, lastModifiedDate: string>>"""


def read_json_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row an item: cve, problems, references (empty tag lists null), descriptions, nodes, impact, dates. An item without id is an error."""
    item = spark.read.schema(JSON_FEED).option("multiLine", True).json(paths).select(F.explode("CVE_Items").alias("i"))
    key = F.col("i.cve.CVE_data_meta.ID")
    refs = F.transform("i.cve.references.reference_data", lambda r: F.struct(r["url"].alias("url"), F.when(F.size(r["tags"]) > 0, r["tags"]).alias("tags")))
    day = lambda c: F.to_date(F.substring(F.col(f"i.{c}"), 1, 10))
    return item.select(
        F.coalesce(key, F.raise_error(F.lit("an item has no id")).cast("string")).alias("cve"),
        F.flatten(F.transform("i.cve.problemtype.problemtype_data", lambda p: F.transform(p["description"], lambda d: d["value"]))).alias("problems"),
        refs.alias("references"), F.transform("i.cve.description.description_data", lambda d: d["value"]).alias("descriptions"), F.col("i.configurations.nodes").alias("nodes"), F.col("i.impact").alias("impact"),
        day("publishedDate").alias("published"), day("lastModifiedDate").alias("lastModified"),
    )


#: Names of the severity fields and where each version has them.
SEVERITY_2 = {
    "CVSS_version": "cvssV2.version", "CVSS_score": "cvssV2.baseScore", "CVSS_AV": "cvssV2.accessVector", "CVSS_AC": "cvssV2.accessComplexity", "CVSS_AuPR": "cvssV2.authentication",
    "CVSS_C": "cvssV2.confidentialityImpact", "CVSS_I": "cvssV2.integrityImpact", "CVSS_A": "cvssV2.availabilityImpact", "CVSS_exploitabilityScore": "exploitabilityScore", "CVSS_impactScore": "impactScore",
}
SEVERITY_3 = {
    "CVSS_version": "cvssV3.version", "CVSS_score": "cvssV3.baseScore", "CVSS_AV": "cvssV3.attackVector", "CVSS_AC": "cvssV3.attackComplexity", "CVSS_AuPR": "cvssV3.privilegesRequired", "CVSS_UI": "cvssV3.userInteraction",
    "CVSS_S": "cvssV3.scope", "CVSS_C": "cvssV3.confidentialityImpact", "CVSS_I": "cvssV3.integrityImpact", "CVSS_A": "cvssV3.availabilityImpact", "CVSS_exploitabilityScore": "exploitabilityScore", "CVSS_impactScore": "impactScore",
}


def severity(impact: str = "impact") -> dict[str, Column]:
    """Severity fields of both versions, 10 and 12, for records of read_json_feed; version 3 wins."""
    from ..operators.merge import project_severity

    at = lambda names, base: {n: F.col(f"{impact}.{base}.{p}") for n, p in names.items()}
    return project_severity(at(SEVERITY_2, "baseMetricV2"), at(SEVERITY_3, "baseMetricV3"))


def as_array(col: str, schema: T.StructType) -> Column:
    """A field that is one element or a list of them, as a list."""
    return F.col(col) if isinstance(schema[col].dataType, T.ArrayType) else F.when(F.col(col).isNotNull(), F.array(col))


def read_xml_catalog(spark: SparkSession, path: str, row_tag: str, key: str, schema: T.StructType | str | None = None, strings: bool = False) -> DataFrame:
    """One row an element of the tag; its ID attribute becomes the key column. strings: all leaves as text. Namespaces are ignored."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("attributePrefix", "_")
    reader = reader.option("inferSchema", not strings) if schema is None else reader.schema(schema)
    df = reader.load(path)
    return df.withColumn(key, F.col("_ID").cast("string")).drop("_ID") if "_ID" in df.columns else df


#: Shape of an OVAL definition.
OVAL = """_id string, _class string, metadata struct<title: string, reference: array<struct<_source: string, _ref_id: string>>,
  oval_repository: struct<dates: struct<submitted: struct<_date: string>, modified: array<struct<_date: string>>, status_change: array<struct<_VALUE: string, _date: string>>>>>"""


def read_oval(spark: SparkSession, path: str) -> DataFrame:
    """Definitions with metadata lifted: oval, class, title, reference, submitted, modified. Those last set to DEPRECATED go."""
    d = read_xml_catalog(spark, path, "definition", "oval", OVAL)
    dates = "metadata.oval_repository.dates"
    last = F.try_element_at(F.col(f"{dates}.status_change"), F.lit(-1))["_VALUE"]
    return d.where(~F.coalesce(last == "DEPRECATED", F.lit(False))).select(
        F.col("_id").alias("oval"), F.col("_class").alias("class"), F.col("metadata.title").alias("title"),
        F.transform("metadata.reference", lambda r: F.struct(r["_source"].alias("source"), r["_ref_id"].alias("ref_id"))).alias("reference"),
        F.col(f"{dates}.submitted._date").alias("submitted"), F.transform(F.col(f"{dates}.modified"), lambda m: m["_date"]).alias("modified"),
    )


#: Fields of text markup, which stand for what they hold.
MARKUP = ("p", "li", "ul", "ol", "div", "i", "b", "class")


def clean_nested(df: DataFrame, drop_keys: tuple[str, ...] = ("br", "style"), text_keys: tuple[str, ...] = MARKUP) -> DataFrame:
    """Nested fields of the given names removed everywhere; empty texts, lists and structs without any value become null. A struct of text markup only (fields of
    text_keys and its own text) becomes one list of the texts it holds, in the schema's order. Walks the schema, not the data."""

    def texts(col: Column, kind: T.DataType) -> Column:
        """All texts inside, as a list."""
        none = F.array().cast("array<string>")
        if isinstance(kind, T.StructType):
            parts = [texts(col[f.name], f.dataType) for f in kind.fields if f.name not in drop_keys]
            return F.coalesce(F.concat(*parts), none) if parts else none
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(col, lambda x: texts(x, kind.elementType))), none)
        text = F.trim(col.cast("string"))
        return F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(none)

    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name not in drop_keys]
            if any(f.name in text_keys for f in kept) and all(f.name in (*text_keys, "_VALUE") for f in kept):
                found = texts(col, kind)
                return F.when(F.size(found) > 0, found)
            if not kept:
                return F.lit(None).cast("string")
            parts = {f.name: clean(col[f.name], f.dataType) for f in kept}
            return F.when(F.coalesce(*(p.isNotNull().cast("int") for p in parts.values())).isNotNull() & F.greatest(*(p.isNotNull() for p in parts.values()), F.lit(False)), F.struct(*(p.alias(n) for n, p in parts.items())))
        if isinstance(kind, T.ArrayType):
            inner = F.filter(F.transform(col, lambda x: clean(x, kind.elementType)), lambda x: x.isNotNull())
            return F.when(F.size(inner) > 0, inner)
        return F.when(F.trim(col) != "", col) if isinstance(kind, T.StringType) else col

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in drop_keys))
