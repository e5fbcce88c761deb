"""Texts are looked at for words before patterns run; no row is lost by it."""

from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import rx
from guidemill.operators import contacts, deadlines, formulas, references

TEXTS = [
    "", None, "Plain words only, 12 of them.", "Add the amounts.", "FORMULA", "ſubtract", "a = b", "==", "calculated  BY hand", "calculated", "3/200 x 5", "3/200", "1/2 × (3 + 44)",
    "Penalty amounts to half of it", "penalty is calculated daily", "VAT due = net x 20", "Income tax is calculated by hand", "Small profits rate is 3/200 of it", "marginal relief 1/2",
    "equation is: something that goes on for a while", "Pay by 31 January.", "within 30 days of the change", "before 15 April", "31 January", "Call us on 0300 200 3310", "helpline", "contact us 8am to 6pm",
    "write to a@hmrc.gov.uk", "+44 300 200 3310", "see section 3.1", "section 4.2 above", "as explained in paragraph 7", "Finance Act 2020", "section 5 of the Taxes Act 1988", "Act of 2020 facts 2020",
    "SI 2020/12", "S.I. 1999/3", "Regulation 12/34", "\"Taxable supply\" means a supply", "within the meaning of it", "ſection 5 of the VAT ACT 1994"]


def found(spark, column):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(2).select("k", column(F.col("t")).alias("x")).collect()
    return [x for _, x in sorted((r["k"], r["x"]) for r in rows)] if all(not isinstance(r["x"], list) for r in rows) and all(r["x"] is not None for r in rows) else {r["k"]: r["x"] for r in rows}


def test_probe_of_formulas_is_unchanged_and_cheaper(spark):
    assert found(spark, formulas.has_formulas) == found(spark, lambda t: t.rlike(rx(fv.FORMULA_PROBE)))
    assert fv.FORMULA_PROBE not in str(formulas.formulas(F.col("t")))


def test_no_row_is_lost(spark):
    dates = found(spark, lambda t: F.when(t.rlike("[0-9]") & deadlines.has_deadlines(t), F.concat(deadlines.known_deadlines(t), deadlines.relative_deadlines(t))))
    assert {k: v or [] for k, v in found(spark, deadlines.deadlines).items()} == {k: v or [] for k, v in dates.items()}
    points = found(spark, contacts.contacts)
    assert [TEXTS[k] for k, v in sorted(points.items()) if v] == ["Call us on 0300 200 3310", "write to a@hmrc.gov.uk", "+44 300 200 3310"]
    known = found(spark, formulas.formulas)
    kinds = {TEXTS[k]: v[0]["formula_type"] for k, v in known.items() if v}
    assert kinds["Small profits rate is 3/200 of it"] == kinds["marginal relief 1/2"] == "marginal_relief"
    assert {"Penalty amounts to half of it", "penalty is calculated daily", "VAT due = net x 20", "Income tax is calculated by hand", "1/2 × (3 + 44)"} <= set(kinds)
    refs = {TEXTS[k]: [r["target_normalized"] for r in v] for k, v in found(spark, references.references).items() if v}
    assert refs["see section 3.1"] == ["section_3.1"] and refs["section 4.2 above"] == ["section_4.2"] and refs["as explained in paragraph 7"] == ["section_7"]
    assert "finance_act_2020" in refs["Finance Act 2020"] and "taxes_act 1988_s5" in refs["section 5 of the Taxes Act 1988"] and "Act of 2020 facts 2020" not in refs
    assert refs["SI 2020/12"] and refs["S.I. 1999/3"] and refs["Regulation 12/34"] and "vat_act_1994" in refs["ſection 5 of the VAT ACT 1994"]
