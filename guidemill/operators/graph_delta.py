"""Reference graph kept up to date from changes of edges and chunks.

Held are the chunks with their sections, the edges as given together with the chunk each of them leads to (``found``), and the
numbers of outgoing and incoming references of every chunk that has any.  A change looks up the sections it touches, the edges
that wait for them and the ends of those edges; what it does not touch is passed on unread by any grouping or sort.

An edge leads to its own target where that is resolved, else to the first chunk of its target section, if there is one.  Edges
that start at a removed chunk go, and so do edges whose own resolved target it is; edges that were led there by their section wait or
are led to the section's next chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ["reference_id", "source_chunk_id", "target_chunk_id", "target_section_id", "is_resolved"]


@dataclass
class ReferenceGraph:
    chunks: DataFrame  # chunk_id, section_id
    edges: DataFrame  # EDGE and found
    degrees: DataFrame  # chunk_id, outgoing, incoming; chunks without references have no row


def _own_target() -> Column:
    return F.when(F.col("is_resolved"), F.col("target_chunk_id"))


def _waits() -> Column:
    return ~F.col("is_resolved") & F.col("target_section_id").isNotNull()


def _led(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the chunk they lead to; only chunks of sections that edges wait for are grouped."""
    wanted = edges.where(_waits()).select(F.col("target_section_id").alias("section_id")).distinct()
    first = chunks.join(wanted, "section_id", "left_semi").groupBy(F.col("section_id").alias("target_section_id")).agg(F.min("chunk_id").alias("_first"))
    return edges.join(first, "target_section_id", "left").select(*EDGE, F.coalesce(_own_target(), F.when(~F.col("is_resolved"), F.col("_first"))).alias("found"))


def _ends(edges: DataFrame, sign: int) -> DataFrame:
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source_chunk_id").alias("chunk_id"), F.lit(sign).alias("outgoing"), F.lit(0).alias("incoming")),
        F.struct(F.col("found").alias("chunk_id"), F.lit(0).alias("outgoing"), F.lit(sign).alias("incoming")))).alias("e")).select("e.*")
    return ends.where(F.col("chunk_id").isNotNull())


def _summed(ends: DataFrame) -> DataFrame:
    return ends.groupBy("chunk_id").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))


def build(chunks: DataFrame, edges: DataFrame) -> ReferenceGraph:
    """The graph of all chunks (unique chunk_id) and edges (unique reference_id); a null is_resolved counts as waiting."""
    held = chunks.select("chunk_id", "section_id")
    led = _led(_clean(edges), held)
    return ReferenceGraph(held, led, _summed(_ends(led, 1)))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).withColumn("is_resolved", F.coalesce("is_resolved", F.lit(False)))


def _marked(rows: DataFrame, ids: DataFrame, column: str, mark: str) -> DataFrame:
    flagged = ids.toDF(column).where(F.col(column).isNotNull()).distinct().withColumn(mark, F.lit(True))
    return rows.join(flagged, column, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def apply_changes(
    graph: ReferenceGraph, changed_edges: DataFrame | None = None, removed_edges: DataFrame | None = None,
    changed_chunks: DataFrame | None = None, removed_chunks: DataFrame | None = None,
) -> ReferenceGraph:
    """The graph after edges and chunks were added or replaced (by id) and removed (frames of ids); a removal wins over a change.

    The frames read the ones before them; after a few rounds the caller writes them, for instance as a published version.
    """
    no_edges, no_chunks = graph.edges.limit(0), graph.chunks.limit(0)
    gone = (no_chunks if removed_chunks is None else removed_chunks).select("chunk_id").distinct()
    new_chunks = (no_chunks if changed_chunks is None else changed_chunks).select("chunk_id", "section_id").join(gone, "chunk_id", "left_anti")
    moved = new_chunks.select("chunk_id").unionByName(gone)
    chunks = graph.chunks.join(moved, "chunk_id", "left_anti").unionByName(new_chunks)

    sections = graph.chunks.join(moved, "chunk_id", "left_semi").select("section_id").unionByName(new_chunks.select("section_id"))
    edge_out = (no_edges if removed_edges is None else removed_edges).select("reference_id")
    edge_in = _clean(no_edges if changed_edges is None else changed_edges)

    marked = _marked(graph.edges, edge_out.unionByName(edge_in.select("reference_id")), "reference_id", "_replaced")
    marked = _marked(marked, gone, "source_chunk_id", "_source_gone")
    marked = _marked(marked.withColumn("_own", _own_target()), gone, "_own", "_target_gone")
    marked = _marked(marked.withColumn("_section", F.when(_waits(), F.col("target_section_id"))), sections, "_section", "_section_moved")
    out = F.col("_replaced") | F.col("_source_gone") | F.col("_target_gone")
    touched = marked.where(out | F.col("_section_moved")).select(*EDGE, "found", out.alias("_out")).checkpoint()  # as large as the change
    fresh = edge_in.join(edge_out, "reference_id", "left_anti").join(gone.toDF("source_chunk_id"), "source_chunk_id", "left_anti") \
        .withColumn("_own", _own_target()).join(gone.toDF("_own"), "_own", "left_anti").select(*EDGE)
    again = _led(touched.where(~F.col("_out")).select(*EDGE).unionByName(fresh), chunks).checkpoint()
    edges = marked.where(~(out | F.col("_section_moved"))).select(*EDGE, "found").unionByName(again)

    steps = _summed(_ends(touched, -1).unionByName(_ends(again, 1))).where("outgoing <> 0 OR incoming <> 0").checkpoint()
    stays = graph.degrees.join(steps.select("chunk_id"), "chunk_id", "left_anti")
    moves = _summed(graph.degrees.join(steps.select("chunk_id"), "chunk_id", "left_semi").unionByName(steps))
    return ReferenceGraph(chunks, edges, stays.unionByName(moves.where("outgoing <> 0 OR incoming <> 0")))


def with_flags(graph: ReferenceGraph) -> DataFrame:
    """(chunk_id, has_outgoing_references, has_incoming_references) of all chunks."""
    return graph.chunks.join(graph.degrees, "chunk_id", "left").select(
        "chunk_id", (F.coalesce("outgoing", F.lit(0)) > 0).alias("has_outgoing_references"), (F.coalesce("incoming", F.lit(0)) > 0).alias("has_incoming_references"))
