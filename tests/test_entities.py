"""Entities are decoded without handing whole pages to Python."""

import html
import re

from pyspark.sql import functions as F

from guidemill.operators import parse

TEXTS = ["", None, "plain", "&amp;", "a &amp;amp;lt;b&gt; &#163;5 &#x41; &nosuch; &", "&lt;p&gt;&quot;x&quot;", "&&amp;&", "&notit; &not &copy2", "end &pound", "é&eacute;\n&nbsp;&#0;"]


def test_decoding_equals_the_plain_one(spark):
    for markup in (False, True):
        def one(m):
            text = html.unescape(html.unescape(m[0]))
            return html.escape(text) if markup else text

        rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("decoded", parse.decode_entities(F.col("text"), markup))
        got = {r["id"]: r["decoded"] for r in rows.collect()}
        assert got == {i: None if t is None else re.sub(parse._ENTITY, one, t) for i, t in enumerate(TEXTS)}


def test_pages_stay_out_of_python(spark):
    """What the function is given are lists of entities."""
    plan = spark.createDataFrame([("x &amp; y",)], "text string").select(parse.decode_entities(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ArrowEvalPython \[batch\((regexp_extract_all|pythonUDF|_)", plan)
