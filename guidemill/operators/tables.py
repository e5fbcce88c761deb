"""Tables in html: headers, typed cells, classification, readable text.

Works on arrays inside the page's row (no shuffle); ``table_rows`` gives one row per table and
``table_cells`` the long form used by lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import (
    empty_array, explode_rows, first_case, first_group, let, literal_map, rx, scan, spans, squeeze, window,
)
from guidemill.functions.values import column_type, number, tax_year
from guidemill.operators.parse import decode_entities, plain

_TR = r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|</table|</thead|</tbody|\z)"
_CELL = r"(?is)<(t[dh])\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|\z)"
_TH = r"(?is)<th\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|\z)"
_THEAD = r"(?is)<thead\b[^>]*>(.*?)(?=</thead|<tbody|\z)"
_TBODY = r"(?is)<tbody\b[^>]*>(.*?)(?=</tbody|</table|\z)"
_TABLE_TAG = r"(?i)</?table\b[^>]*>"
_HIDDEN = r"(?s)<!--.*?-->|(?i)<script\b.*?</script\s*>"


def has_tables(html: Column) -> Column:
    return F.lower(html).contains("<table")


def _texts(markup: Column) -> Column:
    return F.transform(markup, lambda c: squeeze(plain(F.regexp_replace(c, "<[^>]*>", ""))))


def _cells(row: Column) -> Column:
    return _texts(F.regexp_extract_all(row, F.lit(_CELL), F.lit(2)))


def _rows(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(_TR), F.lit(1))


def unique_headers(headers: Column) -> Column:
    """Blank headers are numbered by position; a repeat gets the count of earlier ones."""
    named = F.transform(headers, lambda h, i: F.coalesce(
        F.nullif(h, F.lit("")), F.concat(F.lit("Column_"), i.cast("string"))))

    def suffix(hs: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(hs, F.lit(1), i), lambda x: x == h))
            return F.when(earlier > 0, F.concat(h, F.lit("_"), earlier.cast("string"))).otherwise(h)

        return F.transform(hs, one)

    return let(named, suffix)


def headers(table: Column) -> Column:
    """From thead; else the header cells of the first row; else its cells unless all are numbers."""
    none = F.array().cast("array<string>")
    head_row = F.get(_rows(first_group(table, _THEAD)), F.lit(0))
    first_row = F.get(_rows(table), F.lit(0))
    from_head = F.coalesce(_cells(head_row), none)
    from_th = F.coalesce(_texts(F.regexp_extract_all(first_row, F.lit(_TH), F.lit(1))), none)
    plain_cells = F.coalesce(_cells(first_row), none)
    from_td = F.when(
        F.exists(plain_cells, lambda t: (t != "") & ~t.rlike(r"^[0-9,.%£]+$")), plain_cells).otherwise(none)
    return unique_headers(
        F.when(F.size(from_head) > 0, from_head).when(F.size(from_th) > 0, from_th).otherwise(from_td))


def cell_value(raw: Column) -> Column:
    """struct(raw, num, kind): blank, pound amount, percentage, number or text."""
    blank = (raw == "") | (raw == "-") | (F.lower(raw) == "n/a")
    pounds = number(first_group(raw, rx(fv.POUND_AMOUNT, "")))
    percent = first_group(raw, rx(fv.PERCENT, "")).try_cast("double")
    digits = F.regexp_replace(raw, rx(r"[,\s]", ""), "")
    kind = F.when(raw.isNull() | blank, F.lit(None).cast("string")) \
        .when(pounds.isNotNull(), "currency").when(percent.isNotNull(), "percentage") \
        .when(digits.rlike(r"^-?[0-9]+\.[0-9]+$"), "decimal").when(digits.rlike(r"^-?[0-9]+$"), "integer") \
        .otherwise("text")
    num = F.when(raw.isNull() | blank, F.lit(None).cast("double")) \
        .otherwise(F.coalesce(pounds, percent, F.when(digits.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), digits.try_cast("double"))))
    return F.struct(F.when(~blank, raw).alias("raw"), num.alias("num"), kind.alias("kind"))


def body_rows(table: Column, width: Column) -> Column:
    """Typed rows padded or cut to the header count; rows without any value dropped."""
    has_head = table.rlike(_THEAD)
    without_head = F.regexp_replace(table, r"(?is)<thead\b.*?</thead\s*>", "")
    body = F.coalesce(first_group(table, _TBODY), F.when(has_head, without_head).otherwise(table))
    rows = let(_rows(body), lambda r: F.when(has_head, r).otherwise(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1)))))
    filled = F.filter(F.transform(rows, _cells), lambda c: F.size(c) > 0)
    typed = F.transform(filled, lambda c: F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: cell_value(F.get(c, i))))
    return F.filter(typed, lambda r: F.exists(r, lambda v: v["kind"].isNotNull()))


def _shown(v: Column) -> Column:
    """Value as it reads in running text."""
    return F.when(v["kind"] == "text", v["raw"]) \
        .when(v["kind"] == "integer", v["num"].cast("bigint").cast("string")).otherwise(v["num"].cast("string"))


def table_type(headers_: Column, rows: Column) -> Column:
    """First keyword group found in the headers and the first three rows."""
    sample = F.flatten(F.transform(F.slice(rows, 1, 3), lambda r: F.transform(
        F.filter(r, lambda v: v["kind"].isNotNull()), _shown)))
    text = F.lower(F.concat_ws(" ", F.array_join(headers_, " "), F.array_join(sample, " ")))
    return let(text, lambda t: first_case(t, [(k, t.rlike(rx(p))) for k, p in fv.TABLE_TYPES], "other"))


def readable_text(headers_: Column, rows: Column, name: Column) -> Column:
    """Name, then one bullet line per row with percent and pound formatting."""

    def part(h: Column, v: Column) -> Column:
        is_float = v["kind"].isin("currency", "percentage", "decimal")
        is_rate = F.lower(h).contains("rate") | h.contains("%")
        return F.when(v["kind"].isNotNull(), F.concat(
            h, F.lit(": "),
            F.when(is_float & is_rate, F.concat(_shown(v), F.lit("%")))
            .when(is_float & (v["num"] >= 1000), F.concat(F.lit("£"), F.format_number(v["num"], 0)))
            .otherwise(_shown(v))))

    lines = F.transform(rows, lambda r: F.concat(
        F.lit("  • "), F.array_join(F.zip_with(headers_, r, part), ", ")))
    return F.array_join(F.concat(F.array(F.concat(name, F.lit(":"))), lines), "\n")


def table_blocks(html: Column) -> Column:
    """(block, own) of every table, inner ones included, in order of their start; a table never closed runs to the end.

    ``own`` is the markup without the tables inside its cells, which are tables of their own, at any depth.  Comments and scripts
    hold no tables.
    """
    def blocks(text: Column) -> Column:
        def nested(marks: Column) -> Column:
            def located(depth: Column) -> Column:
                def block(m: Column, i: Column) -> Column:
                    def closed(at: Column) -> Column:
                        # Text behind a mark that leaves this table's own level open is the table's own.
                        behind = F.filter(F.sequence(i, at["last"]), lambda k: F.get(depth, k) == F.get(depth, i))
                        pieces = F.transform(behind, lambda k: window(
                            text, F.when(k == i, m["start"]).otherwise(F.get(marks, k)["end"]), F.when(k == at["last"], at["end"]).otherwise(F.get(marks, k + 1)["start"])))
                        return let(window(text, m["start"], at["end"]), lambda whole: F.struct(
                            whole.alias("block"), F.when(at["last"] > i, F.array_join(pieces, " ")).otherwise(whole).alias("own")))

                    def ended(close: Column) -> Column:
                        return let(F.struct(
                            F.when(close > 0, i + close - 1).otherwise(F.size(depth) - 1).alias("last"),  # the last mark before the closing one
                            F.when(close > 0, F.get(marks, i + close)["end"]).otherwise(F.length(text)).alias("end")), closed)

                    close = F.array_position(F.slice(depth, i + 2, F.size(depth)), F.get(depth, i) - 1).cast("int")
                    return F.when(~m["hit"].startswith("</"), let(close, ended))

                return F.array_compact(F.transform(marks, block))

            step = lambda d, m: F.when(m["hit"].startswith("</"), F.greatest(d - 1, F.lit(0))).otherwise(d + 1)
            return let(scan(marks, F.lit(0), step, "int"), located)

        return let(spans(text, _TABLE_TAG), nested)

    return F.when(has_tables(html), let(F.regexp_replace(html, _HIDDEN, ""), blocks)).otherwise(empty_array("struct<block:string,own:string>"))


def tables(html: Column, year: Column) -> Column:
    """All tables of a page that have headers and rows, with their position; see :func:`decode_entities` for entities."""
    title = literal_map(fv.TABLE_TITLES)

    def build(found: Column, i: Column) -> Column:
        return from_markup(found["own"], found["block"], i)

    def from_markup(own: Column, block: Column, i: Column) -> Column:
        def with_headers(hs: Column) -> Column:
            def with_rows(rows: Column) -> Column:
                def with_type(kind: Column) -> Column:
                    name = F.concat_ws(" ", F.coalesce(F.try_element_at(title, kind), F.lit("Table")), year)
                    types = F.transform(hs, lambda h, c: column_type(F.filter(
                        F.transform(rows, lambda r: F.get(r, c)["raw"]), lambda v: v.isNotNull())))
                    return F.struct(
                        i.alias("position_index"), kind.alias("table_type"), name.alias("table_name"),
                        hs.alias("headers"), types.alias("column_types"), rows.alias("rows"),
                        F.filter(hs, lambda h: F.lower(h).rlike(rx(fv.LOOKUP_COLUMN))).alias("lookup_keys"),
                        F.filter(hs, lambda h: F.lower(h).rlike(rx(fv.VALUE_COLUMN))).alias("value_columns"),
                        year.alias("tax_year"), readable_text(hs, rows, name).alias("readable_text"),
                        block.alias("raw_html"))

                return let(table_type(hs, rows), with_type)

            return let(F.when(F.size(hs) > 0, body_rows(own, F.size(hs))), with_rows)

        return let(headers(own), with_headers)

    return F.filter(F.transform(table_blocks(html), build), lambda t: F.size(t["rows"]) > 0)


def table_rows(pages: DataFrame, key: list[str], html: str = "html", year: Column | None = None,
               text: str | None = None) -> DataFrame:
    """One row per table; the tax year is given or read from the text."""
    y = year if year is not None else (tax_year(F.col(text)) if text else F.lit(None).cast("string"))
    df = pages.withColumn("_year", y.cast("string")).withColumn("_decoded", decode_entities(F.col(html), markup=True))
    return explode_rows(df, tables(F.col("_decoded"), F.col("_year")), key, pos="item_no")


def table_cells(table_rows_: DataFrame, key: list[str]) -> DataFrame:
    """Long form: one row per cell with its header."""
    grid = F.flatten(F.transform("rows", lambda r, i: F.transform(r, lambda v, c: F.struct(
        i.alias("row_idx"), c.alias("col_idx"), F.get(F.col("headers"), c).alias("header"),
        v["raw"].alias("raw"), v["num"].alias("num"), v["kind"].alias("kind")))))
    return explode_rows(table_rows_, grid, key, pos="cell_no").drop("cell_no")
