"""Reference graph between chunks: expansion, resolution, flags, reports; crawl of a hierarchy.

Edges have: reference_id, source_chunk_id, target_chunk_id, reference_type, reference_strength,
target_section_id, is_resolved.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidemill.functions import fixed_values as fv
from guidemill.operators.circles import circle_members  # noqa: F401  part of the graph's interface
from guidemill.session import ensure_checkpoint_dir
from guidemill.sources.tables import written


def strength_rank(strength: Column) -> Column:
    rank = F.when(strength == fv.REFERENCE_STRENGTHS[0], 0)
    for i, s in enumerate(fv.REFERENCE_STRENGTHS[1:], 1):
        rank = rank.when(strength == s, i)
    return rank.otherwise(len(fv.REFERENCE_STRENGTHS))


def usable_edges(edges: DataFrame, strengths: Sequence[str], cap: int) -> DataFrame:
    """Best edge per (source, target), and per source only the targets an expansion can still take.

    One hop skips at most ``cap`` visited targets and takes at most ``cap`` new ones, so the first
    ``2 * cap`` targets of a source in follow order decide the result exactly.  Spark applies the
    rank limit before the exchange, so a hub's other edges are not shuffled.
    """
    resolved = edges.where(
        F.col("is_resolved") & F.col("target_chunk_id").isNotNull() & F.col("reference_strength").isin(*strengths))
    best = resolved.groupBy("source_chunk_id", "target_chunk_id").agg(
        F.min(F.struct(strength_rank(F.col("reference_strength")).alias("rank"), "reference_id")).alias("e"))
    order = Window.partitionBy("source_chunk_id").orderBy("e.rank", "target_chunk_id")
    return best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 2 * cap).select(
        "source_chunk_id", "target_chunk_id", F.col("e.rank").alias("rank"), F.col("e.reference_id").alias("reference_id"))


def expand_references(
    seeds: DataFrame, edges: DataFrame, max_depth: int = 1,
    strengths: Sequence[str] = ("required", "recommended"), max_total: int = 10, request: str | None = None,
) -> DataFrame:
    """Expansion of many seeds in one job: (seed, chunk_id, hop, reference_id followed).

    ``seeds`` has a column ``chunk_id``.  With ``request``, a column of the seeds, all seeds of a request are expanded together:
    they share visited nodes and the cap, and ``seed`` holds the request.  Per hop: join the newest nodes to the edges, drop visited
    nodes, take new ones by strength and target id until a seed holds ``max_total`` nodes.  Each hop is cut off
    from the plan with a checkpoint.
    """
    if max_depth < 1 or max_total < 1:
        raise ValueError("depth and nodes must be at least 1")
    ensure_checkpoint_dir(seeds.sparkSession)
    usable = usable_edges(edges, strengths, max_total)
    if max_depth > 1:
        usable = usable.checkpoint()
    reached = seeds.select(
        F.col(request or "chunk_id").alias("seed"), "chunk_id", F.lit(0).alias("hop"), F.lit(None).cast("bigint").alias("reference_id")).distinct()
    for hop in range(1, max_depth + 1):
        frontier = reached.where(F.col("hop") == hop - 1).select("seed", F.col("chunk_id").alias("source_chunk_id"))
        steps = frontier.join(usable, "source_chunk_id")
        found = steps.groupBy("seed", F.col("target_chunk_id").alias("chunk_id")).agg(
            F.min(F.struct("rank", "reference_id")).alias("e"))
        fresh = found.join(reached.select("seed", "chunk_id"), ["seed", "chunk_id"], "left_anti")
        held = reached.groupBy("seed").agg(F.count("*").alias("held"))
        order = Window.partitionBy("seed").orderBy("e.rank", "chunk_id")
        ranked = fresh.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_total)
        taken = ranked.join(held, "seed").where(F.col("rn") + F.col("held") <= max_total).select(
            "seed", "chunk_id", F.lit(hop).alias("hop"), F.col("e.reference_id").alias("reference_id"))
        reached = reached.unionByName(taken)
        if hop < max_depth:
            reached = reached.checkpoint()
    return reached


def definition_chain(seeds: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """Expansion along required edges only."""
    return expand_references(seeds, edges, max_depth, (fv.REFERENCE_STRENGTHS[0],), 10)


def crawl(edges: DataFrame, roots: DataFrame, failed: DataFrame | None = None, max_nodes: int | None = None) -> DataFrame:
    """Breadth-first reach over child edges: (node, level); failed nodes are skipped with what hangs below them.

    ``edges`` has (source, target), ``roots`` and ``failed`` have ``node``.  Levels are added until no
    new node appears or ``max_nodes`` are held; order within a level is by node.
    """
    def usable(nodes: DataFrame) -> DataFrame:
        return nodes if failed is None else nodes.join(failed.select("node"), "node", "left_anti")

    frontier = written(usable(roots.select("node").distinct()).withColumn("level", F.lit(0)), "frontier")
    reached, held = frontier, frontier.count()
    for level in count(1):
        if max_nodes and held >= max_nodes:
            break
        nxt = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = written(usable(nxt.join(reached.select("node"), "node", "left_anti")).withColumn("level", F.lit(level)), "frontier")
        added = frontier.count()
        if added == 0:
            break
        reached, held = reached.unionByName(frontier), held + added
    return reached.orderBy("level", "node").limit(max_nodes) if max_nodes else reached


def resolve_references(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Resolve all waiting edges whose target section now has a chunk (the first chunk of a section)."""
    first = chunks.where(F.col("section_id").isNotNull()).groupBy(F.col("section_id").alias("target_section_id")).agg(
        F.min("chunk_id").alias("_found"))
    joined = edges.join(first, "target_section_id", "left")
    hit = ~F.col("is_resolved") & F.col("_found").isNotNull()
    return joined.withColumn("target_chunk_id", F.when(hit, F.col("_found")).otherwise(F.col("target_chunk_id"))) \
        .withColumn("is_resolved", F.col("is_resolved") | hit).drop("_found")


def with_reference_flags(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """has_outgoing_references / has_incoming_references from the edges; keys are reduced before the join."""
    ends = edges.select(F.col("source_chunk_id").alias("chunk_id"), F.lit(True).alias("o"), F.lit(False).alias("i")).unionByName(
        edges.where(F.col("is_resolved") & F.col("target_chunk_id").isNotNull()).select(
            F.col("target_chunk_id").alias("chunk_id"), F.lit(False).alias("o"), F.lit(True).alias("i")))
    flags = ends.groupBy("chunk_id").agg(
        F.bool_or("o").alias("has_outgoing_references"), F.bool_or("i").alias("has_incoming_references"))
    out = chunks.drop("has_outgoing_references", "has_incoming_references").join(flags, "chunk_id", "left")
    return out.fillna(False, ["has_outgoing_references", "has_incoming_references"])


def outgoing(edges: DataFrame, chunk_ids: Sequence, strengths: Sequence[str] | None = None, resolved_only: bool = False) -> DataFrame:
    df = edges.where(F.col("source_chunk_id").isin(*chunk_ids))
    if strengths:
        df = df.where(F.col("reference_strength").isin(*strengths))
    return df.where(F.col("is_resolved")) if resolved_only else df


def incoming(edges: DataFrame, chunk_ids: Sequence, strengths: Sequence[str] | None = None) -> DataFrame:
    df = edges.where(F.col("target_chunk_id").isin(*chunk_ids) & F.col("is_resolved"))
    return df.where(F.col("reference_strength").isin(*strengths)) if strengths else df


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("is_resolved"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Number of chunks that refer to others, and of chunks that are referred to."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.lit("outgoing").alias("direction"), F.col("source_chunk_id").alias("chunk_id")),
        F.struct(F.lit("incoming").alias("direction"), F.when(F.col("is_resolved"), F.col("target_chunk_id")).alias("chunk_id")))).alias("e")).select("e.*")
    return ends.where(F.col("chunk_id").isNotNull()).distinct().groupBy("direction").agg(F.count(F.lit(1)).alias("chunks"))


def delete_for_chunks(edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Edges that neither start nor end at one of the chunks."""
    ids = chunk_ids.select("chunk_id").distinct()
    return edges.join(ids, edges.source_chunk_id == ids.chunk_id, "left_anti").join(
        ids, F.col("target_chunk_id") == ids.chunk_id, "left_anti")


def reference_stats(edges: DataFrame) -> DataFrame:
    """Totals, by type and by strength in one pass: (breakdown, label, references, resolved, unresolved)."""
    sets = edges.groupingSets(
        [[], [F.col("reference_type")], [F.col("reference_strength")]], "reference_type", "reference_strength"
    ).agg(F.grouping_id().alias("gid"), F.count("*").alias("reference_count"), F.count_if("is_resolved").alias("resolved"))
    return sets.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "type").otherwise("strength").alias("breakdown"),
        F.coalesce("reference_type", "reference_strength", F.lit("all")).alias("label"), "reference_count", "resolved",
        (F.col("reference_count") - F.col("resolved")).alias("unresolved"))


def most_referenced(edges: DataFrame, k: int = 10) -> DataFrame:
    """Top k chunks by resolved incoming edges; ties by id."""
    return edges.where(F.col("is_resolved")).groupBy(F.col("target_chunk_id").alias("chunk_id")).agg(
        F.count("*").alias("reference_count")).orderBy(F.desc("reference_count"), "chunk_id").limit(k)


def most_referencing(edges: DataFrame, k: int = 10) -> DataFrame:
    return edges.groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(
        F.count("*").alias("reference_count")).orderBy(F.desc("reference_count"), "chunk_id").limit(k)


def graph_summary(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks, chunks with references, references."""
    total = chunks.agg(F.count("*").alias("n")).scalar()
    return edges.agg(
        F.count_distinct("source_chunk_id").alias("chunks_with_references"), F.count("*").alias("total_references")
    ).select(total.alias("total_chunks"), "chunks_with_references", "total_references")


def circular_references(edges: DataFrame) -> DataFrame:
    """Pairs of chunks that refer to each other, and chunks that refer to themselves."""
    pairs = edges.where(F.col("is_resolved") & F.col("target_chunk_id").isNotNull()).select(
        F.col("source_chunk_id").alias("a"), F.col("target_chunk_id").alias("b")).distinct()
    # Both directions of a pair meet in one group, so no self-join is needed.
    ordered = pairs.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b"), (F.col("a") <= F.col("b")).alias("forward"))
    both = ordered.groupBy("chunk_a", "chunk_b").agg(F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("r"))
    return both.where((F.col("chunk_a") == F.col("chunk_b")) | (F.col("f") & F.col("r"))).select("chunk_a", "chunk_b")


def with_citations(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with section and citation of both ends."""
    c = chunks.select("chunk_id", "section_id", "citable_reference")
    src = c.select(F.col("chunk_id").alias("source_chunk_id"), F.col("section_id").alias("source_section_id"),
                   F.col("citable_reference").alias("source_citable_reference"))
    dst = c.select(F.col("chunk_id").alias("target_chunk_id"), F.col("citable_reference").alias("target_citable_reference"))
    return edges.join(src, "source_chunk_id", "left").join(dst, "target_chunk_id", "left")


def chunks_with_references(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, target_chunk_id, reference_type, target citation) for resolved outgoing edges.

    Long form on purpose: a list per chunk would put a hub's edges into one row.
    """
    resolved = edges.where(F.col("is_resolved")).select(
        F.col("source_chunk_id").alias("chunk_id"), "target_chunk_id", "reference_type").distinct()
    dst = chunks.select(F.col("chunk_id").alias("target_chunk_id"), F.col("citable_reference").alias("target_citable_reference"))
    return chunks.select("chunk_id").join(resolved, "chunk_id").join(dst, "target_chunk_id", "left")
