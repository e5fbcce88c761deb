"""Merged metadata against a fold in plain Python; documents with open keys."""

import json
import random
from datetime import date

from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.operators import merge_state as ms
from guidemill.operators import open_documents as od

SCHEMA = "g string, n int, tax_years array<string>, topics array<string>, forms array<struct<code:string,name:string>>, lang string"
PARTS = {"sets": ("tax_years", "topics"), "lists": ("forms",), "newest": ("lang",)}


def fold(rows):
    out = {}
    for g, _, years, topics, forms, lang in sorted(rows, key=lambda r: r[1]):
        held = out.setdefault(g, ([], [], [], [None]))
        for into, labels in ((held[0], years), (held[1], topics)):
            into += [x for x in dict.fromkeys(labels or []) if x is not None and x not in into]
        held[2].extend(forms or [])
        held[3][0] = lang if lang is not None else held[3][0]
    return {g: v for g, v in out.items() if any(v[:3]) or v[3][0] is not None}


def test_merge_is_the_fold_of_the_rows(spark):
    pick = random.Random(4)
    some = lambda xs, most: pick.choice([None, [], [pick.choice(xs) for _ in range(pick.randint(1, most))]])
    rows = [(pick.choice(["hot", "hot", "a", "b", None]), n, some(["x", "y", "z", None], 4), some(["t", "u"], 2),
             some([("F1", "one"), ("F2", None)], 3), pick.choice([None, "en", "de"])) for n in range(200)]
    rows.append(("void", 200, None, [], None, None))
    want = fold(rows)
    for cuts in (1, 3, 7):
        parts = [spark.createDataFrame(rows[k::cuts], SCHEMA).repartition(3) for k in range(cuts)]
        states = [ms.merge_state(p, ["g"], "n", **PARTS) for p in parts]
        pick.shuffle(states)
        state = ms.combine([ms.combine(states[:2], ["g"]), *states[2:]], ["g"]).checkpoint()
        got = ms.merged_labels(state, ["g"], PARTS["sets"], PARTS["newest"], PARTS["lists"]).collect()
        assert {r["g"]: (r["tax_years"], r["topics"], r["n_forms"], r["lang"]) for r in got} == {g: (v[0], v[1], len(v[2]), v[3][0]) for g, v in want.items()}
        items = ms.merged_items(state, ["g"], "forms", "struct<code:string,name:string>").orderBy("row", "pos").collect()
        assert {g: [tuple(r["item"]) for r in items if r["g"] == g] for g in want} == {g: v[2] for g, v in want.items()}
    none = ms.merge_state(spark.createDataFrame([], SCHEMA), ["g"], "n", **PARTS)
    assert ms.merged_labels(none, ["g"], PARTS["sets"], PARTS["newest"], PARTS["lists"]).count() == 0


def test_vector_row_has_all_fields(spark):
    assert len(fv.VECTOR_ROW_FIELDS) == len(set(fv.VECTOR_ROW_FIELDS)) == 33
    flags = [f for f in fv.VECTOR_ROW_FIELDS if f.startswith(("has_", "contains_", "requires", "deadline_s", "penalty"))]
    lists = ["topic_secondary", "business_types", "keywords", "form_references", "applies_to_tax_years", "structured_content_types"]
    df = spark.range(1).select(F.lit(7).alias("chunk_id"), *[
        F.lit(False).alias(f) if f in flags else F.array(F.lit("k")).alias(f) if f in lists else F.array(F.lit(5)).alias(f) if f == "threshold_values"
        else F.lit(date(2024, 4, 6)).alias(f) if f == "publication_date" else F.lit(0).alias(f) if f in ("chunk_index", "document_id", "reliability_tier")
        else F.lit("v").alias(f) for f in fv.VECTOR_ROW_FIELDS])
    row = json.loads(od.vector_rows(df).select(F.to_json("metadata").alias("m")).first()["m"])
    assert set(row) == set(fv.VECTOR_ROW_FIELDS) and row["publication_date"] == "2024-04-06" and row["threshold_values"] == [5] and row["penalty_relevant"] is False
    bare = spark.createDataFrame([(1, "", None, "", '{"mine": {"a": [1, null]}, "content_type": "x", "tax_year": "2020"}'), (2, None, [], "VAT", "[1"), (3, "t", ["a"], None, None)],
                                 "chunk_id int, section_title string, keywords array<string>, topic_primary string, more string")
    got = {r["chunk_id"]: json.loads(r["m"]) for r in od.vector_rows(bare, more="more").select("chunk_id", F.to_json("metadata").alias("m")).collect()}
    base = {"topic_primary": "Other", "content_type": "factual", "service_category": "none"}
    assert got == {1: {**base, "mine": {"a": [1, None]}, "tax_year": "2020"}, 2: {**base, "topic_primary": "VAT"}, 3: {**base, "section_title": "t", "keywords": ["a"]}}


def test_patches_and_key_types(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}', '{"a": "x", "d": null}'), (2, None, '{"a": 1}'), (3, '{"z": 1}', None), (4, "5", "[]")], "id int, doc string, patch string")
    after = docs.select("id", od.patched(F.parse_json("doc"), F.parse_json("patch"), ["d"]).alias("v"))
    assert {r["id"]: json.loads(r["j"]) for r in after.select("id", F.to_json("v").alias("j")).collect()} == {1: {"a": "x", "b": {"c": 2}}, 2: {"a": 1}, 3: {"z": 1}, 4: {}}
    assert sorted((r["id"], r["name"], r["value"]) for r in od.entries(after, "id", "v").collect()) == [(1, "a", '"x"'), (1, "b", '{"c":2}'), (2, "a", "1"), (3, "z", "1")]
    types = od.key_schema(after.where("id <= 3 AND id <> 2"), "v").first()["schema"]
    assert "a: STRING" in types and "z: BIGINT" in types and "c: BIGINT" in types


def test_rows_are_evaluated_once(spark):
    """Labels, newest values and list items come from one evaluation of rows that may be costly."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def tags(k):
        seen.add(1)
        return [str(k % 3), "x"]

    rows = spark.range(20, numPartitions=2).select(F.lit("a").alias("g"), F.col("id").alias("n"), F.udf(tags, "array<string>")("id").alias("tags"), F.lit("v").alias("last"))
    state = ms.merge_state(rows, ["g"], "n", ("tags",), (), ("last",))
    merged = ms.merged_labels(ms.combine([state], ["g"]), ["g"], ("tags",), ("last",)).collect()
    assert [(r["g"], r["tags"], r["last"]) for r in merged] == [("a", ["0", "x", "1", "2"], "v")]
    assert seen.value == 20
