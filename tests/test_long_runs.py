"""Patterns on long texts, and cheap tests before patterns: nothing is lost by them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.functions.matching import _begin, first_at, folded, rx, spans
from guidemill.llm import packing
from guidemill.operators import circles, legal, references


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column.alias("x"))
    return [r.x for r in sorted(df.collect())]


def test_long_runs_of_words_and_figures_keep_to_the_stack(spark):
    words, figures = "Supply " + "of goods " * 200_000, "£1" + ",1" * 400_000
    flags = F.struct(legal.has_definition(F.col("text")).alias("d"), legal.has_penalty(F.col("text")).alias("p"))
    texts = [words + "- means. It", words + "-\nelse means", figures + " penalty", figures + " of late fines"]
    assert [tuple(x) for x in values(spark, texts, flags)] == [(True, False), (False, False), (False, True), (False, True)]


def test_manual_ids_are_found_at_their_digits(spark):
    texts = ["See VATREG02200, ctm01500 and BIM456789 XBIM45000 é CG12345.", "PIM1234 12345 _NIM12345", "ch00001eim00002 EIM00003", "🙂 TSEM10000", None]
    plain = re.compile(r"\b(" + "|".join(p[3:-3] for p in fv.MANUAL_ID_PATTERNS.values()) + r")\b", re.I)
    expected = [[(m.start(), m.end(), m.group(1)) for m in plain.finditer(t or "")] for t in texts]
    found = values(spark, texts, references._manual_spans(F.col("text")))
    assert [[(s.start, s.end, s.g1) for s in row] for row in found] == expected and sum(map(len, expected)) == 5


@pytest.mark.parametrize("pattern", [fv.CONDITION_LEAD_IN, fv.FORM_CODE_WIDE, *fv.TERM_REFERENCES, *fv.EXAMPLE_STARTS, *fv.CONTACT_INDICATORS])
def test_first_characters_leave_matches_as_they_are(spark, pattern):
    texts = ["You must (a): suppoſe that for example: SA100, 'x' means y. Contact us", "the term \"a\" is defined in: within the meaning of b", "ſA100 P11D(b) xEPS EPS", " get help helpline"]
    found = values(spark, texts, F.regexp_extract_all("text", F.lit(rx(pattern)), F.lit(0)))
    assert found == values(spark, texts, F.regexp_extract_all("text", F.lit("(?Udi)" + pattern), F.lit(0)))
    assert [[s.hit for s in row] for row in values(spark, texts, spans(F.col("text"), rx(pattern)))] == found


def test_first_characters_of_patterns():
    assert _begin(r"\b(?:see|refer)\s") == "(?=[rs])" and _begin(r"(?:a|b)*") == "" and _begin(r"\s*x") == "" and _begin("plain") == ""


def test_folded_finds_what_patterns_without_case_find(spark):
    assert values(spark, ["ſECTİON Key dıe", "É SEE"], folded(F.col("text"))) == ["section key die", "é see"]
    assert values(spark, ["🙂ab\n\nC", "none", "\n\nC"], first_at(F.col("text"), rx(r"\n\n(?=[A-Z])", ""))) == [3, None, 1]


def test_lead_ins_lie_between_full_stops(spark):
    texts = ["One. You must register if: this.\nTwo you should do. A company must: x\nyou can: y", "You must. Not: here", None]
    starts = values(spark, texts, legal.lead_in_starts(F.col("text")))
    assert starts[:2] == [[m.start() for m in re.finditer(fv.CONDITION_LEAD_IN, t, re.I | re.M)] for t in texts[:2]]


def test_circles_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(circles, "written", lambda df, label, keep=circles.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    edges = spark.createDataFrame([(1, 2, True), (2, 3, True), (3, 1, True), (3, 4, True), (4, 3, True)], "source_chunk_id long, target_chunk_id long, is_resolved boolean")
    found = circles.circle_members(edges)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.chunk_id: r.circle for r in found.collect()} == {1: 4, 2: 4, 3: 4, 4: 4}
    assert not any("Broadcast" in p for p in plans)


def test_packing_loads_the_tokenizer_for_special_texts_only():
    from guidemill.llm.queries import vocabulary_files

    files = vocabulary_files()
    tokens = packing.Tokens(*files, packing.vocabulary_facts(files[0]))
    assert len(tokens.encode("some plain words")) and tokens.slow is None
    if tokens.special:
        assert len(tokens.encode("x" + tokens.special[0])) and tokens.slow is not None
