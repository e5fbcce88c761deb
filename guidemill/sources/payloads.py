"""Content-API payloads (one json string per row) to source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import literal_strings

_LINK = "array<struct<title:string,base_path:string,document_type:string>>"
PAYLOAD_DDL = (
    "struct<base_path:string,title:string,description:string,document_type:string,schema_name:string,"
    "first_published_at:string,public_updated_at:string,"
    f"links:struct<taxons:{_LINK},parent:{_LINK},children:{_LINK},child_taxons:{_LINK}>,"
    "details:struct<body:string,introduction:string,parts:array<struct<title:string,body:string>>,"
    f"child_section_groups:array<struct<title:string,child_sections:{_LINK}>>>>"
)


def normalize_path(url: Column) -> Column:
    """Full address or bare path to ``/path``."""
    path = F.when(url.startswith("http"), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#;]*)", 1)).otherwise(url)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def parse_time(text: Column) -> Column:
    """ISO time as UTC; a bare date is midnight; a bad value is null."""
    return F.to_utc_timestamp(
        F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text)), F.current_timezone())


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _links(*lists: Column, with_type: bool = False) -> Column:
    def item(x: Column) -> Column:
        fields = [_or_empty(x["title"]).alias("title"), _or_empty(x["base_path"]).alias("path")]
        if with_type:
            fields.append(_or_empty(x["document_type"]).alias("document_type"))
        return F.struct(*fields)

    return F.concat(*[F.coalesce(F.transform(x, item), F.slice(F.array(item(F.lit(None).cast(
        "struct<title:string,base_path:string,document_type:string>"))), 1, 0)) for x in lists])


def breadcrumbs(p: Column) -> Column:
    """Taxons, then parents: array of struct(title, path)."""
    return _links(p["links"]["taxons"], p["links"]["parent"])


def child_sections(p: Column) -> Column:
    """Children, then child taxons: array of struct(title, path, document_type)."""
    return _links(p["links"]["children"], p["links"]["child_taxons"], with_type=True)


def body_html(p: Column) -> Column:
    """Body; else the parts of a guide; else the introduction; else section groups as lists of links."""
    d = p["details"]

    def non_empty(*parts: Column) -> Column:
        return F.array_compact(F.array(*parts))

    def part(x: Column) -> Column:
        return non_empty(
            F.when(x["title"] != "", F.concat(F.lit("<h2>"), x["title"], F.lit("</h2>"))), F.nullif(x["body"], F.lit("")))

    def group(x: Column) -> Column:
        items = F.transform(x["child_sections"], lambda s: F.concat(
            F.lit('<li><a href="'), _or_empty(s["base_path"]), F.lit('">'), _or_empty(s["title"]), F.lit("</a></li>")))
        listed = F.when(F.size(x["child_sections"]) > 0, F.concat(
            literal_strings(["<ul>"]), items, literal_strings(["</ul>"])))
        title = non_empty(F.when(x["title"] != "", F.concat(F.lit("<h2>"), x["title"], F.lit("</h2>"))))
        return F.concat(title, F.coalesce(listed, F.array().cast("array<string>")))

    def lines(c: Column, f) -> Column:
        return F.when(F.size(c) > 0, F.array_join(F.flatten(F.transform(c, f)), "\n"))

    return F.coalesce(
        F.nullif(d["body"], F.lit("")), lines(d["parts"], part), F.nullif(d["introduction"], F.lit("")),
        lines(d["child_section_groups"], group), F.lit(""))


def section_hierarchy(crumbs: Column) -> Column:
    """Titles of the breadcrumbs that have one."""
    return F.transform(F.filter(crumbs, lambda b: b["title"] != ""), lambda b: b["title"])


def source_rows(payloads: DataFrame, raw: str = "raw", path: str | None = None) -> DataFrame:
    """Source row envelope; the payload stays as a column.

    ``path`` names the requested address; without it the payload's own base path is used.  A payload that is null or
    no json object gives a row with ``error`` set.
    """
    df = payloads.withColumn("_p", F.from_json(F.col(raw), PAYLOAD_DDL[:-1] + ",unreadable:string>", {"columnNameOfCorruptRecord": "unreadable"}))
    p = F.col("_p")
    parent = F.get(p["links"]["parent"], F.lit(0))
    df = df.withColumn("base_path", normalize_path(p["base_path"] if path is None else F.col(path)))
    return df.withColumns({
        "url": F.concat(F.lit(fv.SITE_ADDRESS), F.col("base_path")),
        "title": F.coalesce(p["title"], F.lit("Untitled")),
        "description": p["description"],
        "body_html": body_html(p),
        "document_type": F.coalesce(p["document_type"], F.lit("unknown")),
        "schema_name": F.coalesce(p["schema_name"], F.lit("unknown")),
        "first_published": parse_time(p["first_published_at"]),
        "last_updated": parse_time(p["public_updated_at"]),
        "breadcrumbs": breadcrumbs(p),
        "parent_title": parent["title"],
        "parent_path": parent["base_path"],
        "child_sections": child_sections(p),
        "error": F.when(F.col(raw).isNull() | p["unreadable"].isNotNull(), "Payload is not readable json"),
    }).drop("_p")


def child_edges(sources: DataFrame) -> DataFrame:
    """Edge per child section: (parent, child)."""
    return sources.select(F.col("base_path").alias("source"), F.explode_outer("child_sections").alias("c")).where(
        F.col("c.path") != "").select("source", F.col("c.path").alias("target"))
