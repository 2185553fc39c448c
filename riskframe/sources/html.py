"""Fields and tables out of crawled HTML, by expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(html: Column, pattern: str) -> Column:
    """First capture, tags stripped and trimmed; check and close icons are True and False; empty and N/A are null."""
    got = F.regexp_extract(html, pattern, 1)
    icon = F.when(got.rlike("class=\"[^\"]*check"), "True").when(got.rlike("class=\"[^\"]*close"), "False")
    plain = F.trim(F.regexp_replace(got, "<[^>]*>", ""))
    return F.coalesce(icon, F.when(~plain.isin("", "N/A"), plain))


def extract_fields(df: DataFrame, html_col: str, first: dict[str, str], last: dict[str, str] | None = None) -> DataFrame:
    """df with the first match of each pattern in `first` and the last of each in `last`; pages without any match go."""
    cols = {n: field(F.col(html_col), p) for n, p in first.items()}
    cols |= {n: F.try_element_at(F.regexp_extract_all(F.col(html_col), F.lit(p), F.lit(1)), F.lit(-1)) for n, p in (last or {}).items()}
    return df.withColumns(cols).where(F.coalesce(*cols).isNotNull())


def detail_page(pages: DataFrame) -> DataFrame:
    """page_id, title, number of paragraphs and kind (`host - section`) of pages with a body."""
    html, url = F.col("html"), F.col("url")
    section = F.coalesce(F.nullif(F.regexp_extract(url, "://[^/]*/([a-z]+)/", 1), F.lit("")), F.lit("none"))
    paragraphs = F.floor((F.length(html) - F.length(F.replace(html, F.lit("<p")))) / 2)
    valid = pages.where(F.contains(html, F.lit("<body")))
    return valid.select("page_id", F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), paragraphs.alias("paragraphs"), F.concat(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(" - "), section).alias("kind"))


def extract_tables(df: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, row_no, cells): rows of HTML tables as maps from header to cell; `#` headers, empty headers and nan cells are left out."""
    rows = F.regexp_extract_all(F.col(html_col), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row, tag: F.transform(F.regexp_extract_all(row, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    listed = df.select(key, rows.alias("rows")).where("size(rows) > 1").select(key, cells(F.col("rows")[0], "th").alias("head"), F.posexplode(F.slice("rows", 2, 1_000_000)).alias("row_no", "row"))
    pairs = F.filter(F.arrays_zip("head", cells(F.col("row"), "td").alias("cell")), lambda p: ~p["head"].isin("#", "") & ~F.startswith(p["head"], F.lit("Unnamed")) & p["cell"].isNotNull() & (F.lower(p["cell"]) != "nan"))
    return listed.select(key, "row_no", F.map_from_entries(pairs).alias("cells"))


#: Labels of the scalar fields on a record's detail page, by the field's name.
DETAIL = {
    "cvss score": "CVSS Score", "confidentiality imp.": "Confidentiality Impact", "integrity imp.": "Integrity Impact", "availability imp.": "Availability Impact", "complexity": "Access Complexity",
    "authentication": "Authentication", "gained acc.": "Gained Access", "vul. type": "Vulnerability Type(s)", "cwe": "CWE ID",
}
#: Headings of its tables, as patterns.
DETAIL_TABLES = {"prod. affected": "Products Affected By CVE-[0-9-]+", "versions affected": "Number Of Affected Versions By Product", "references": "References For CVE-[0-9-]*"}
#: What stands for no value.
NOTHING = ("", "None", "for more information)", "CWE id is not defined for this vulnerability")


def table_rows(table: Column) -> Column:
    """Rows of an HTML table as maps from header to cell: `#`, empty and Unnamed headers and nan cells are left out."""
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "&nbsp;?", " "))
    cells = lambda row, tag: F.transform(F.regexp_extract_all(row, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), text)
    named = lambda p: ~p["head"].isin("#", "") & ~F.startswith(p["head"], F.lit("Unnamed")) & p["cell"].isNotNull() & (F.lower(p["cell"]) != "nan")
    listed = F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    # arrays of one element bind the rows, then the header, so that each is found once
    parts = F.transform(F.array(listed), lambda r: F.struct(cells(F.get(r, F.lit(0)), "th").alias("head"), F.slice(r, 2, 1 << 30).alias("rows")))
    maps = F.transform(parts, lambda p: F.transform(p["rows"], lambda row: F.map_from_entries(F.filter(F.arrays_zip(p["head"].alias("head"), cells(row, "td").alias("cell")), named))))
    return F.get(F.filter(maps, lambda m: F.size(m) > 0), F.lit(0))


def detail_record(df: DataFrame, html_col: str = "html", key_name: str = "cve") -> DataFrame:
    """df with `detail`: the record that a vulnerability's page describes, as one struct. Pages of unknown ids and pages that hold none of it are left out.

    Fields: the id, the scalar fields of DETAIL (what stands before the value inside its cell is dropped; the type is `text - class` where it is marked with one), the description with its line breaks, the
    two dates of the note inside it, products and versions affected (lists of maps), references (first words of their cells) and the exploit modules' table.
    """
    html = F.col(html_col)
    found = lambda pattern, source=html: F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))
    value = lambda c: F.when(~F.coalesce(c.isin(*NOTHING), F.lit(True)), c)
    last = lambda c: F.trim(F.regexp_replace(c, r"(?s)^.*>", ""), F.lit(" \t\r\n"))
    cell = {n: found(rf"(?s)\Q{label}\E\s*</[^>]*>\s*(.*?)</") for n, label in DETAIL.items()}
    fields = {n: value(last(c)) for n, c in cell.items()}
    marked = F.nullif(F.regexp_extract(cell["vul. type"], '<span class="([^"]*)">', 1), F.lit(""))
    fields["vul. type"] = F.when(marked.isNotNull(), F.concat(fields["vul. type"], F.lit(" - "), marked)).otherwise(fields["vul. type"])
    summary = found(r'(?s)<div class="cvedetailssummary"[^>]*>(.*?)</div>')
    note = found(r'(?s)<span class="datenote">(.*)', summary)
    text = F.regexp_replace(F.regexp_replace(summary, r'(?s)<span class="datenote">.*', ""), r"<br\s*/?>", "\n")
    day = lambda label: found(rf"{label} ?: ?([0-9-]+)", note)
    section = lambda heading: found(rf"(?s){heading}\s*</[^>]*>\s*(<table.*?</table>)")
    tables = {n: table_rows(section(h)) for n, h in DETAIL_TABLES.items() if n != "references"}
    cells = F.regexp_extract_all(section(DETAIL_TABLES["references"]), F.lit(r"(?s)<td[^>]*>\s*(.*?)\s*</td>"), F.lit(1))
    tables["references"] = F.filter(F.transform(cells, lambda c: F.split(F.trim(F.regexp_replace(c, "<[^>]*>", "")), r"\s")[0]), lambda u: u != "")
    modules = found(r'(?s)<div id="metasploitmodstable">(.*?)</div>')
    known = {
        key_name: found("Vulnerability Details *: *<[^>]*>(CVE-[0-9-]+)</"), **fields, "description": value(F.trim(F.regexp_replace(text, "<[^>]*>", ""), F.lit(" \t\r\n"))),
        "publish date": day("Publish ?Date"), "last mod date": day("Last ?Update ?Date"), **tables, "metasploitable": table_rows(modules),
    }
    page = df.where(~F.coalesce(F.contains(html, F.lit("<strong>Unknown CVE ID</strong>")), F.lit(True)))
    # a list of one struct, so that the filter on it doesn't take the page apart a second time
    done = page.withColumn("detail", F.explode(F.array(F.struct(*(c.alias(n) for n, c in known.items())))))
    held = [F.col("detail").getField(n).isNotNull() for n in known]
    return done.where(reduce(lambda a, b: a | b, held))
