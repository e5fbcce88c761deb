"""Extractors on inline texts with exact expected rows."""

import json

import pytest

from pyspark.sql import functions as F

from guidemill.functions import values
from guidemill.functions.matching import spans, with_context
from guidemill.operators import (
    conditions, contacts, deadlines, examples, formulas, legal, metadata, references, tables,
)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_spans_point_at_their_text(texts):
    t = "a1 bb22 ü333 x"
    r = one(texts(t).select(spans(F.col("text"), "([a-zü]+)([0-9]+)", 2).alias("s"))).s
    assert [(x.start, x.end, x.hit, x.g1, x.g2) for x in r] == [(0, 2, "a1", "a", "1"), (3, 7, "bb22", "bb", "22"), (8, 12, "ü333", "ü", "333")]
    assert all(t[x.start:x.end] == x.hit for x in r)


def test_context_window(texts):
    r = one(texts("xxxxxKEYyyyyy").select(with_context(F.col("text"), "KEY", 3).alias("s"))).s[0]
    assert (r.context_before, r.context_after, r.full_context) == ("xxx", "yyy", "xxxKEYyyy")


def test_values(texts):
    df = texts("Pay £12570 or £1,234.56, at 20% and 5.5 %, in 2024/25 and 2023-2024 on 31 january 2026. SA100, vat1, SA100; not 1999-05")
    r = one(df.select(
        values.pound_amount(F.col("text")).alias("a"), values.pound_amounts(F.col("text")).alias("all"),
        values.percentage(F.col("text")).alias("p"), values.percentages(F.col("text")).alias("ps"),
        values.tax_year(F.col("text")).alias("y"), values.tax_years(F.col("text")).alias("ys"),
        values.form_codes(F.col("text")).alias("f"), values.day_month_year(F.col("text")).alias("d")))
    assert r.a == 12570.0 and r["all"] == [12570.0, 1234.56]
    assert r.p == 20.0 and r.ps == [20.0, 5.5]
    assert r.y == "2024-25" and r.ys == ["2024-25", "2023-24"]
    assert r.f == ["SA100", "VAT1"]
    assert (r.d.day, r.d.month, r.d.year) == (31, "January", 2026)


def test_column_type(spark):
    df = spark.createDataFrame([(["£1", "£2", "x"],), (["1", "2,000", "3.5"],), (["5%", "a"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(values.column_type(F.col("v"))).collect()] == ["currency_gbp", "number", "text", "text"]


GUIDE = (
    "Rules for the 2024-25 season. The registration threshold: £81,400 holds for a limited company or sole trader alike. "
    "Whoever has taxable supplies above £81,400 sends form VAT1. The personal allowance: £11,930. "
    "File the SA100 tax return by 31 January and each VAT return in its quarter, or a penalty follows. Payment is made on 7 May."
)


def test_metadata(texts):
    r = one(metadata.with_metadata(texts(GUIDE)))
    assert [(t.value, t.type, t.formatted) for t in r.thresholds] == [
        (81400, "vat_registration", "£81,400"), (11930, "personal_allowance", "£11,930")]
    assert "registration threshold: £81,400" in r.thresholds[0].context
    assert r.tax_years == ["2024-25"]
    assert [(f.code, f.name) for f in r.forms] == [
        ("VAT1", "VAT registration application"), ("SA100", "Self Assessment tax return (main form)")]
    assert [(d.day, d.month, d.type) for d in r.key_dates] == [(31, "January", "deadline"), (7, "May", "payment")]
    assert r.topics == ["vat", "self_assessment"]
    assert r.business_types == ["sole_trader", "limited_company"]
    assert r.keywords == sorted(r.keywords) and {"vat1", "sa100", "vat return", "sole trader"} <= set(r.keywords)


def test_metadata_merge_and_hints(texts):
    df = texts(GUIDE, "Corporation tax and marginal relief for 2023-24.").withColumn("g", F.lit(1))
    m = one(metadata.merge_labels(metadata.with_metadata(df), ["g"]))
    assert m.tax_years == ["2023-24", "2024-25"] and m.topics == ["corporation_tax", "self_assessment", "vat"]
    both = metadata.with_metadata(texts(GUIDE)).select(F.struct("*").alias("a"))
    pair = one(both.withColumn("b", F.col("a")).select(*[c.alias(n) for n, c in metadata.merge_pair("a", "b").items()]))
    assert len(pair.thresholds) == 4 and pair.topics == ["vat", "self_assessment"]
    h = metadata.chunk_hints(df).orderBy("doc_id").collect()[0]
    assert h.threshold_values == [81400, 11930] and h.threshold_type == "vat_registration"
    assert h.deadlines_mentioned == ["31 January", "7 May"] and h.penalty_relevant and h.deadline_sensitive


REFS = (
    "For registration see VATREG02200 and also CTM01500. As explained in section 3.2 this replaces bim45000. "
    "The Finance Act 2024 applies, with section 45 of the Taxes Act 1988 and SI 2003/3143. "
    "'Taxable turnover' means all supplies, and VATREG02200 again. EU Regulation 282/2011."
)


def test_references(texts):
    rows = references.reference_rows(texts(REFS), ["doc_id"]).collect()
    got = [(r.reference_type, r.reference_text, r.target_normalized) for r in rows]
    assert got == [
        ("hmrc_manual", "VATREG02200", "vatreg02200"), ("hmrc_manual", "CTM01500", "ctm01500"),
        ("hmrc_manual", "BIM45000", "bim45000"), ("section", "section 3.2", "section_3.2"),
        ("legislation", "Finance Act 2024", "finance_act_2024"),
        ("legislation", "Taxes Act 1988", "taxes_act_1988"),
        ("legislation", "s.45 Taxes Act 1988", "taxes_act_1988_s45"),
        ("legislation", "2003/3143", "2003/3143"), ("legislation", "282/2011", "282/2011"),
        ("definition", "Taxable turnover", "taxable_turnover"),
    ]
    first = rows[0]
    assert REFS[first.position:first.position + 11] == "VATREG02200" and first.relationship_type == "references"
    assert first.target_url.endswith("/hmrc-internal-manuals/vatreg02200")
    assert {r.reference_text: r.relationship_type for r in rows}["BIM45000"] == "references"


def test_links(spark):
    html = ("<p>See <a href=\"/guidance/x\">the <b>guide</b></a>, <a href='#top'>top</a>, <a href='/search?q'>s</a>"
            " <a href=https://www.gov.uk/y>y &amp; z</a> <a href='https://other.org'>o</a> <a href='/guidance/x'>again</a></p>")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = references.link_rows(df, ["page_id"]).collect()
    assert sorted((r.reference_text, r.target_url) for r in rows) == [
        ("the guide", "https://www.gov.uk/guidance/x"), ("y & z", "https://www.gov.uk/y")]


def test_known_and_relative_deadlines(texts):
    t = ("Send the return by 31 January or a penalty of £100 applies; paper by 31 October. The 15 April does not count. "
         "You must register within 30 days of the change.")
    rows = deadlines.deadline_rows(texts(t), ["doc_id"]).collect()
    assert [(r.deadline_name, r.deadline_type, r.rule_day, r.rule_month, r.rule_value, r.suggested_reminder_days) for r in rows] == [
        ("Self Assessment Tax Return and Payment", "filing", 31, 1, None, 30),
        ("Paper Self Assessment Deadline", "filing", 31, 10, None, 30),
        ("Within 30 days deadline", "registration", None, None, 30, 14)]
    assert rows[0].penalty_description == "penalty of £100"
    assert rows[0].applies_to == ["self_employed", "landlord", "high_earner"]


def test_contacts(texts):
    t = ("Contact us on the helpline 03002003310 Monday to Friday, 8am to 6pm. " + "x " * 400
         + "For VAT telephone 0300 200 3700 or write to vat.help@hmrc.gov.uk; not me@example.org.")
    rows = contacts.contact_rows(texts(t), ["doc_id"]).collect()
    assert {r.service_name for r in rows} == {"Self Assessment Helpline", "VAT Helpline"}
    sa = next(r for r in rows if r.service_category == "self_assessment")
    assert (sa.contact_methods[0].value, sa.contact_methods[0].hours) == ("0300 200 3310", "8am to 6pm, Monday to Friday")
    vat = next(r for r in rows if r.service_category == "vat")
    assert [(m.type, m.value) for m in vat.contact_methods] == [("phone", "0300 200 3700"), ("email", "vat.help@hmrc.gov.uk")]
    assert contacts.contact_rows(texts("nothing here"), ["doc_id"]).count() == 0


MUST = ("Some lines first.\n\nYou must register for a stall if:\n(a) the table takes more than £730 in one week\n"
        "(b) goods worth £730 wait in the van\n(c) the crew grows by 15% or more\n\nThe market opens at nine.")


def test_conditions(texts):
    r = one(conditions.condition_list_rows(texts(MUST), ["doc_id"]))
    assert (r.condition_name, r.condition_type, r.logical_operator) == ("Requirement conditions for register for a stall", "requirement", r.logical_operator)
    assert [(c.id, c.text) for c in r.conditions] == [
        ("a", "the table takes more than £730 in one week"), ("b", "goods worth £730 wait in the van"),
        ("c", "the crew grows by 15% or more")]
    assert [v.value for v in r.conditions[0].variables] == ["730"] and r.conditions[2].variables[0].type == "percentage"
    assert r.outcome_if_met == "You must register for a stall"
    numbered = "You can claim relief if all of the following apply:\n1. the first condition is long enough to pass fifty\n2. the second one\n3. the third"
    rows = conditions.condition_list_rows(texts(numbered), ["doc_id"]).collect()
    assert [len(x.conditions) for x in rows] == [3, 3] and [x.logical_operator for x in rows] == ["OR", "AND"]


def test_examples(texts):
    t = ("Example: Mary earns £31,200 and pays income tax.\nStep 1: Take off the allowance 31,200 - 11,930 = £19,270\n"
         "Step 2: Lower rate 19,270 x 10% = £1,927\nTotal tax: £1,927")
    r = examples.example_rows(texts(t), ["doc_id"]).collect()[0]
    assert (r.name, r.income, r.example_category) == ("Mary", 31200, "income_tax")
    assert r.example_name == "Mary - £31,200 income - Income Tax Example"
    assert r.scenario_description == "Mary has income of £31,200"
    assert [(s.step, s.result) for s in r.steps][:2] == [(1, 19270.0), (2, 1927.0)]
    assert r.steps[0].calculation == "31,200 - 11,930"
    assert (r.result_value, r.result_formatted) == (1927.0, "£1,927.00")


def test_formulas(texts):
    t = "Marginal relief is worked out as 3/200 × (£240,000 - profits). The penalty is calculated by days late. VAT due = net x 20."
    rows = formulas.formula_rows(texts(t), ["doc_id"]).collect()
    mr = rows[0]
    assert mr.formula_type == "marginal_relief" and mr.variables == ["augmented_profits", "taxable_profits", "upper_limit", "fraction"]
    logic = json.loads(mr.formula_logic)
    assert logic["fraction"] == "3/200" and logic["upper_limit"] == 240000
    assert {"penalty_calculation", "vat_calculation"} <= {r.formula_type for r in rows}
    names = [r.formula_name for r in rows]
    assert len(names) == len(set(names))


TABLE = """<h2>Tiers</h2><table><thead><tr><th>Band</th><th>Taxable income</th><th>Rate</th></tr></thead><tbody>
<tr><td>Lower</td><td>£3,001 to £8,900</td><td>11%</td></tr><tr><td>Upper</td><td>&pound;8,901</td><td>35%</td></tr>
<tr><td>Nil</td><td>-</td><td>n/a</td></tr><tr><td></td><td></td></tr></tbody></table><!-- <table><tr><th>no</th></tr><tr><td>1</td></tr></table> -->
<table><tr><td>Item</td><td></td><td>Item</td></tr><tr><td>a</td><td>1,000</td></tr></table><table><tr><td>1</td></tr></table>"""


def test_tables_inside_tables(spark):
    html = ("<table title='5&#39; wide'><tr><th>Kind</th><th>Sum</th></tr><tr><td>A</td><td>&pound;7</td></tr>"
            "<tr><td>B <table><tr><th>In</th><th>Out</th></tr><tr><td>1</td><td>2</td></tr></table></td><td>7%</td></tr><tr><td>C</td><td>9</td></tr></table>" + "<!-- x -->" * 400)
    rows = tables.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"]).collect()
    assert [(r.position_index, r.headers, [v.num for x in r.rows for v in x]) for r in rows] == [
        (0, ["Kind", "Sum"], [None, 7.0, None, 7.0, None, 9.0]), (1, ["In", "Out"], [1.0, 2.0])]
    assert rows[0].raw_html.endswith("</table>") and rows[1].raw_html in rows[0].raw_html


def test_tables(spark):
    df = spark.createDataFrame([(1, TABLE, "tax year 2024-25")], "page_id int, html string, text string")
    rows = tables.table_rows(df, ["page_id"], text="text").collect()
    t = rows[0]
    assert len(rows) == 2 and (t.table_type, t.table_name, t.position_index) == ("tax_rates", "Tax Rates 2024-25", 0)
    assert t.headers == ["Band", "Taxable income", "Rate"] and len(t.rows) == 3
    assert t.column_types == ["text", "currency_gbp", "percentage"]
    assert [v.num for v in t.rows[0]] == [None, 3001.0, 11.0] and t.rows[2][1].kind is None
    assert t.lookup_keys == ["Band"] and t.value_columns == ["Rate"]
    assert t.readable_text.split("\n")[:2] == ["Tax Rates 2024-25:", "  • Band: Lower, Taxable income: £3,001, Rate: 11.0%"]
    assert rows[1].headers == ["Item", "Column_1", "Item_1"] and rows[1].rows[0][2].kind is None
    cells = tables.table_cells(tables.table_rows(df, ["page_id"], text="text"), ["page_id", "position_index"])
    assert cells.where("header = 'Rate' and row_idx = 1").collect()[0].num == 35.0


def test_legal_flags(texts):
    df = texts('"Input tax" means tax on purchases.', "Payment is due by 31 January.", MUST, "Nothing special here at all")
    got = [r.content_type for r in legal.with_flags(df, "text").orderBy("doc_id").collect()]
    assert got == ["definition", "deadline", "condition_list", "general"]


def test_legal_chunks(texts):
    body = ("Guidance in VATREG02200 tells you about CTM01500 and BIM45000. " * 5) + "See section 4.1 for more."
    r = one(legal.chunk_texts(texts(body), ["doc_id"], title=F.lit("Vat guide")))
    assert r.section_id == "VATREG02200" and r.citable_reference == "HMRC VAT Manual, VATREG02200"
    assert r.cross_references == ["BIM45000", "CTM01500", "section 4.1"]
    assert r.content.startswith("## Vat guide\n\n") and r.total_chunks == 1


def test_lists_stay_whole(texts):
    filler = "This sentence fills the page with words. " * 60
    body = filler + "\n\nYou must tell us if any of the following apply:\n" + "\n".join(
        f"({c}) condition {c} " + "words " * 60 for c in "abcde") + "\n\n" + filler
    pieces = [r.content for r in legal.chunk_texts(texts(body), ["doc_id"]).orderBy("chunk_index").collect()]
    holding = [p for p in pieces if "(a) condition" in p]
    assert len(holding) == 1 and all(f"({c}) condition" in holding[0] for c in "abcde")
    assert len(pieces) == 2 or len(pieces) == 3


@pytest.mark.parametrize("levels", [2, 5, 6, 8])
def test_tables_inside_tables_at_any_depth(spark, levels):
    """Each table has its own header and row, whatever lies in its cells."""
    inner = ""
    for k in reversed(range(levels)):
        inner = f"<table><tr><th>Head {k}</th><th>Rate</th></tr><tr><td>Row {k} {inner}</td><td>{k}%</td></tr></table>"
    page = spark.createDataFrame([(1, f"<p>x</p>{inner}<table><tr><th>After</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>")], "doc_id int, html string")
    rows = tables.table_rows(page, ["doc_id"]).orderBy("item_no").collect()
    assert [(r["headers"][0], [[c["raw"] for c in row] for row in r["rows"]]) for r in rows] == [(f"Head {k}", [[f"Row {k}", f"{k}%"]]) for k in range(levels)] + [("After", [["1", "2"]])]
