"""Reference graph: parts are chunks, consecutive lines of an order are edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from guidemill.operators import graph
from guidemill.sources.tables import read_table

_EDGE_COLUMNS = [
    "l_orderkey * 1000 + n AS reference_id", "l_partkey AS source_chunk_id",
    "CASE WHEN l_discount < 0.08 THEN nxt END AS target_chunk_id",
    "CASE l_returnflag WHEN 'R' THEN 'definition' WHEN 'A' THEN 'see_also' ELSE 'legislation' END AS reference_type",
    "CASE WHEN l_quantity < 10 THEN 'required' WHEN l_quantity < 30 THEN 'recommended' ELSE 'optional' END AS reference_strength",
    "'S' || nxt AS target_section_id", "l_discount < 0.08 AS is_resolved",
]
_CHUNK_COLUMNS = ["p_partkey AS chunk_id", "CASE WHEN p_size < 25 THEN 'S' || p_partkey END AS section_id",
                  "'Manual, ' || p_name AS citable_reference", "p_brand AS topic"]
_EDGES = (f"e AS (SELECT {', '.join(_EDGE_COLUMNS)} FROM (SELECT *, lead(l_partkey) OVER w AS nxt, row_number() OVER w AS n "
          f"FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_returnflag)) "
          f"WHERE nxt IS NOT NULL), c AS (SELECT {', '.join(_CHUNK_COLUMNS)} FROM part)")


def edges(spark, path):
    li = read_table(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    return li.withColumn("nxt", F.lead("l_partkey").over(w)).withColumn("n", F.row_number().over(w)).where("nxt IS NOT NULL").selectExpr(*_EDGE_COLUMNS)


def chunks(spark, path):
    return read_table(spark, path, "part").selectExpr(*_CHUNK_COLUMNS)


def expand_references(spark, path):
    r = graph.expand_references(chunks(spark, path).select("chunk_id"), edges(spark, path), max_depth=2, max_total=10)
    return r.select("seed", "chunk_id", F.col("hop").cast("bigint").alias("hop"), "reference_id")


def expand_requests(spark, path):
    """The parts of one brand and size are one request, expanded under one cap."""
    seeds = read_table(spark, path, "part").selectExpr("p_brand || '/' || p_size AS request", "p_partkey AS chunk_id")
    r = graph.expand_references(seeds, edges(spark, path), max_depth=2, max_total=30, request="request")
    return r.select("seed", "chunk_id", F.col("hop").cast("bigint").alias("hop"), "reference_id")


def definition_chains(spark, path):
    r = graph.definition_chain(chunks(spark, path).select("chunk_id"), edges(spark, path))
    return r.select("seed", "chunk_id", F.col("hop").cast("bigint").alias("hop"), "reference_id")


def _expand_sql(strengths: str, cap: int) -> str:
    return f"""WITH {_EDGES},
u AS (SELECT source_chunk_id AS s, target_chunk_id AS t, rank, reference_id FROM (
  SELECT *, CASE reference_strength WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END AS rank,
    row_number() OVER (PARTITION BY source_chunk_id, target_chunk_id ORDER BY CASE reference_strength WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, reference_id) AS rn
  FROM e WHERE is_resolved AND reference_strength IN ({strengths})) WHERE rn = 1),
h0 AS (SELECT chunk_id AS seed, chunk_id FROM c),
h1 AS (SELECT seed, chunk_id, reference_id FROM (SELECT h0.seed, u.t AS chunk_id, reference_id,
    row_number() OVER (PARTITION BY h0.seed ORDER BY rank, t) AS rn FROM h0 JOIN u ON u.s = h0.chunk_id WHERE u.t <> h0.seed) WHERE rn + 1 <= {cap}),
held AS (SELECT seed, count(*) AS held FROM (SELECT seed FROM h0 UNION ALL SELECT seed FROM h1) GROUP BY seed),
f2 AS (SELECT seed, t, rank, reference_id FROM (SELECT h1.seed, u.t, rank, u.reference_id,
    row_number() OVER (PARTITION BY h1.seed, u.t ORDER BY rank, u.reference_id) AS rn FROM h1 JOIN u ON u.s = h1.chunk_id
    WHERE u.t <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 v WHERE v.seed = h1.seed AND v.chunk_id = u.t)) WHERE rn = 1),
h2 AS (SELECT seed, t AS chunk_id, reference_id FROM (SELECT f2.*, held.held, row_number() OVER (PARTITION BY f2.seed ORDER BY rank, t) AS rn
    FROM f2 JOIN held ON held.seed = f2.seed) WHERE rn + held <= {cap})
SELECT seed, chunk_id, 0::BIGINT AS hop, NULL::BIGINT AS reference_id FROM h0 UNION ALL SELECT seed, chunk_id, 1, reference_id FROM h1
UNION ALL SELECT seed, chunk_id, 2, reference_id FROM h2"""


# All seeds of a request count as visited and against the cap from the start.
_REQUEST_SQL = f"""WITH {_EDGES},
u AS (SELECT source_chunk_id AS s, target_chunk_id AS t, rank, reference_id FROM (
  SELECT *, CASE reference_strength WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END AS rank,
    row_number() OVER (PARTITION BY source_chunk_id, target_chunk_id ORDER BY CASE reference_strength WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, reference_id) AS rn
  FROM e WHERE is_resolved AND reference_strength IN ('required', 'recommended')) WHERE rn = 1),
h0 AS (SELECT DISTINCT p_brand || '/' || p_size AS seed, p_partkey AS chunk_id FROM part),
n0 AS (SELECT seed, count(*) AS held FROM h0 GROUP BY seed),
f1 AS (SELECT h0.seed, u.t, min(rank * 1000000000000 + u.reference_id) AS best FROM h0 JOIN u ON u.s = h0.chunk_id
    WHERE NOT EXISTS (SELECT 1 FROM h0 v WHERE v.seed = h0.seed AND v.chunk_id = u.t) GROUP BY h0.seed, u.t),
h1 AS (SELECT seed, t AS chunk_id, best % 1000000000000 AS reference_id FROM (SELECT f1.*, n0.held, row_number() OVER (PARTITION BY f1.seed ORDER BY best // 1000000000000, t) AS rn
    FROM f1 JOIN n0 ON n0.seed = f1.seed) WHERE rn + held <= 30),
a1 AS (SELECT seed, chunk_id FROM h0 UNION ALL SELECT seed, chunk_id FROM h1),
n1 AS (SELECT seed, count(*) AS held FROM a1 GROUP BY seed),
f2 AS (SELECT h1.seed, u.t, min(rank * 1000000000000 + u.reference_id) AS best FROM h1 JOIN u ON u.s = h1.chunk_id
    WHERE NOT EXISTS (SELECT 1 FROM a1 v WHERE v.seed = h1.seed AND v.chunk_id = u.t) GROUP BY h1.seed, u.t),
h2 AS (SELECT seed, t AS chunk_id, best % 1000000000000 AS reference_id FROM (SELECT f2.*, n1.held, row_number() OVER (PARTITION BY f2.seed ORDER BY best // 1000000000000, t) AS rn
    FROM f2 JOIN n1 ON n1.seed = f2.seed) WHERE rn + held <= 30)
SELECT seed, chunk_id, 0::BIGINT AS hop, NULL::BIGINT AS reference_id FROM h0 UNION ALL SELECT seed, chunk_id, 1, reference_id FROM h1
UNION ALL SELECT seed, chunk_id, 2, reference_id FROM h2"""


def resolve_references(spark, path):
    return graph.resolve_references(edges(spark, path), chunks(spark, path)).select("reference_id", "target_chunk_id", "is_resolved")


def reference_flags(spark, path):
    return graph.with_reference_flags(chunks(spark, path), edges(spark, path)).select(
        "chunk_id", "has_outgoing_references", "has_incoming_references")


def reference_stats(spark, path):
    return graph.reference_stats(edges(spark, path))


def outgoing_references(spark, path):
    return graph.outgoing(edges(spark, path), [1, 2, 3], ["required", "recommended"], True).select("reference_id", "target_chunk_id")


def incoming_references(spark, path):
    return graph.incoming(edges(spark, path), [1, 2, 3], ["required", "recommended"]).select("reference_id", "source_chunk_id")


def unresolved_references(spark, path):
    return graph.unresolved(edges(spark, path)).select("reference_id", "source_chunk_id", "target_section_id")


def references_of_brand_deleted(spark, path):
    gone = chunks(spark, path).where("topic = 'Brand#1'")
    return graph.delete_for_chunks(edges(spark, path), gone).select("reference_id")


def most_referenced(spark, path):
    return graph.most_referenced(edges(spark, path), 10)


def circles(spark, path):
    """Chunks on circles of references of any length."""
    return graph.circle_members(edges(spark, path))


def circles_required(spark, path):
    """Same along required definitions only: a sparse graph of chains and few circles."""
    return graph.circle_members(edges(spark, path).where("reference_strength = 'required' AND reference_type = 'definition'"))


def _circles_sql(where: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, p AS (SELECT DISTINCT source_chunk_id AS a, target_chunk_id AS b FROM e WHERE is_resolved AND target_chunk_id IS NOT NULL {where}),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT r.a AS chunk_id, max(r.b) AS circle FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY r.a"""


def most_referencing(spark, path):
    return graph.most_referencing(edges(spark, path), 10)


def graph_summary(spark, path):
    return graph.graph_summary(chunks(spark, path), edges(spark, path))


def circular_references(spark, path):
    return graph.circular_references(edges(spark, path))


def references_with_citations(spark, path):
    return graph.with_citations(edges(spark, path), chunks(spark, path)).select(
        "reference_id", "source_section_id", "source_citable_reference", "target_citable_reference")


def chunks_with_references(spark, path):
    return graph.chunks_with_references(chunks(spark, path), edges(spark, path)).select(
        "chunk_id", "target_chunk_id", "reference_type", "target_citable_reference")


def _tree(spark, path):
    """Customers as a manual: ten children per section, by key."""
    c = read_table(spark, path, "customer").select(F.col("c_custkey").alias("target"), "c_acctbal")
    e = c.where("target > 0").select(F.floor(F.col("target") / 10).alias("source"), "target")
    return c, e


def crawl_hierarchy(spark, path):
    """Whole manual from the root; sections in deep debt cannot be fetched."""
    c, e = _tree(spark, path)
    failed = c.where("c_acctbal < -900").select(F.col("target").alias("node"))
    roots = c.where("target = 0").select(F.col("target").alias("node"))
    return graph.crawl(e, roots, failed).select("node", F.col("level").cast("bigint").alias("level"))


def crawl_with_limit(spark, path):
    c, e = _tree(spark, path)
    roots = c.where("target = 0").select(F.col("target").alias("node"))
    return graph.crawl(e, roots, max_nodes=50).select("node", F.col("level").cast("bigint").alias("level"))


_CRAWL = """WITH RECURSIVE r(node, level) AS (SELECT c_custkey, 0::BIGINT FROM customer WHERE c_custkey = 0 {root}
UNION ALL SELECT c.c_custkey, r.level + 1 FROM r JOIN customer c ON c.c_custkey // 10 = r.node AND c.c_custkey > 0 {child})
SELECT node, level FROM r"""


_FOLLOW = "is_resolved AND reference_strength IN ('required', 'recommended')"
QUERIES = {
    "expand_requests": (expand_requests, _REQUEST_SQL),
    "circles": (circles, _circles_sql("")),
    "circles_required": (circles_required, _circles_sql("AND reference_strength = 'required' AND reference_type = 'definition'")),
    "expand_references": (expand_references, _expand_sql("'required', 'recommended'", 10)),
    "definition_chains": (definition_chains, _expand_sql("'required'", 10)),
    "resolve_references": (resolve_references, f"""WITH {_EDGES}, f AS (SELECT section_id, min(chunk_id) AS found FROM c WHERE section_id IS NOT NULL GROUP BY 1)
SELECT reference_id, CASE WHEN NOT is_resolved AND found IS NOT NULL THEN found ELSE target_chunk_id END AS target_chunk_id,
  is_resolved OR found IS NOT NULL AS is_resolved FROM e LEFT JOIN f ON f.section_id = e.target_section_id"""),
    "reference_flags": (reference_flags, f"""WITH {_EDGES} SELECT chunk_id, chunk_id IN (SELECT source_chunk_id FROM e) AS has_outgoing_references,
  chunk_id IN (SELECT target_chunk_id FROM e WHERE is_resolved) AS has_incoming_references FROM c"""),
    "reference_stats": (reference_stats, f"""WITH {_EDGES}, s AS (
  SELECT 'total' AS breakdown, 'all' AS label, is_resolved FROM e UNION ALL SELECT 'type', reference_type, is_resolved FROM e
  UNION ALL SELECT 'strength', reference_strength, is_resolved FROM e)
SELECT breakdown, label, count(*) AS reference_count, count(*) FILTER (WHERE is_resolved) AS resolved,
  count(*) FILTER (WHERE NOT is_resolved) AS unresolved FROM s GROUP BY 1, 2"""),
    "outgoing_references": (outgoing_references, f"WITH {_EDGES} SELECT reference_id, target_chunk_id FROM e WHERE source_chunk_id IN (1, 2, 3) AND {_FOLLOW}"),
    "incoming_references": (incoming_references, f"WITH {_EDGES} SELECT reference_id, source_chunk_id FROM e WHERE target_chunk_id IN (1, 2, 3) AND {_FOLLOW}"),
    "unresolved_references": (unresolved_references, f"WITH {_EDGES} SELECT reference_id, source_chunk_id, target_section_id FROM e WHERE NOT is_resolved"),
    "references_of_brand_deleted": (references_of_brand_deleted, f"""WITH {_EDGES}, x AS (SELECT chunk_id FROM c WHERE topic = 'Brand#1')
SELECT reference_id FROM e WHERE source_chunk_id NOT IN (SELECT chunk_id FROM x) AND (target_chunk_id IS NULL OR target_chunk_id NOT IN (SELECT chunk_id FROM x))"""),
    "most_referenced": (most_referenced, f"""WITH {_EDGES} SELECT target_chunk_id AS chunk_id, count(*) AS reference_count FROM e WHERE is_resolved
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "most_referencing": (most_referencing, f"WITH {_EDGES} SELECT source_chunk_id AS chunk_id, count(*) AS reference_count FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "graph_summary": (graph_summary, f"WITH {_EDGES} SELECT (SELECT count(*) FROM c) AS total_chunks, count(DISTINCT source_chunk_id) AS chunks_with_references, count(*) AS total_references FROM e"),
    "circular_references": (circular_references, f"""WITH {_EDGES}, p AS (SELECT DISTINCT source_chunk_id AS a, target_chunk_id AS b FROM e WHERE is_resolved)
SELECT p.a AS chunk_a, p.b AS chunk_b FROM p JOIN p q ON q.a = p.b AND q.b = p.a WHERE p.a <= p.b"""),
    "references_with_citations": (references_with_citations, f"""WITH {_EDGES} SELECT reference_id, s.section_id AS source_section_id,
  s.citable_reference AS source_citable_reference, t.citable_reference AS target_citable_reference
FROM e LEFT JOIN c s ON s.chunk_id = source_chunk_id LEFT JOIN c t ON t.chunk_id = target_chunk_id"""),
    "chunks_with_references": (chunks_with_references, f"""WITH {_EDGES} SELECT DISTINCT source_chunk_id AS chunk_id, target_chunk_id, reference_type,
  c.citable_reference AS target_citable_reference FROM e JOIN c ON c.chunk_id = target_chunk_id WHERE is_resolved AND source_chunk_id IN (SELECT chunk_id FROM c)"""),
    "crawl_hierarchy": (crawl_hierarchy, _CRAWL.format(root="AND c_acctbal >= -900", child="AND c.c_acctbal >= -900")),
    "crawl_with_limit": (crawl_with_limit, _CRAWL.format(root="", child="") + " ORDER BY level, node LIMIT 50"),
}
