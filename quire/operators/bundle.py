"""A bundle of index tables as one thing: whether its parts fit together, and its counts.

Tables of a bundle: documents (version, status), blocks (block, version, kind, text), links (version, target, location),
sections (section, version, parent, text), spans (section, block, start, end, source_start, source_end), chunks (chunk,
section, version, start, end, text, locations), nodes (node), edges (edge, source, target, relation, conditions, reviewer,
day) and evidence (edge, section, version, start, end, quote, locations, link_target). Ids are longs, locations arrays of
strings; a span without a source_end isn't a copy of its block.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.sections import relation_problem

#: Unique keys, and references (table, column, table referred to, its key, what it is called where it is missing).
KEYS = {"documents": "version", "blocks": "block", "sections": "section", "chunks": "chunk", "nodes": "node", "edges": "edge"}
REFERENCES = (
    ("sections", "version", "documents", "version", "section without document"), ("sections", "parent", "sections", "section", "section without parent"),
    ("spans", "block", "blocks", "block", "span without block"), ("spans", "section", "sections", "section", "span without section"),
    ("chunks", "section", "sections", "section", "chunk without section"), ("evidence", "section", "sections", "section", "evidence without section"),
    ("evidence", "edge", "edges", "edge", "evidence without edge"), ("edges", "source", "nodes", "node", "edge without source"), ("edges", "target", "nodes", "node", "edge without target"),
)
OWN = {"sections": "section", "spans": "section", "chunks": "chunk", "evidence": "edge", "edges": "edge"}


def found(rows: DataFrame, problem: str | Column, key: str) -> DataFrame:
    return rows.select((F.lit(problem) if isinstance(problem, str) else problem).alias("problem"), F.col(key).cast("string").alias("key"))


def together(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def pieces(wanted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, start, end, piece): what stands in texts (key, text) at wanted places (key, start, end); null where they aren't within the text.

    A text moves once, to all its places; places that several rows name are cut once.
    """
    places = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("places"))
    cut = texts.select(key, F.col("text").alias("whole")).join(places, key).select(key, "whole", F.explode("places").alias("p"))
    good = (F.col("p.start") >= 0) & (F.col("p.end") > F.col("p.start")) & (F.col("p.end") <= F.length("whole"))
    return cut.select(key, "p.start", "p.end", F.when(good, F.expr("substring(whole, p.start + 1, p.end - p.start)")).alias("piece"))


def repeated(bundle: Mapping[str, DataFrame]) -> DataFrame:
    one = lambda name, key: bundle[name].groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return together(found(one(name, key), f"repeated {key}", key) for name, key in KEYS.items())


def missing(bundle: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that refer to a row that isn't there."""
    rows = []
    for name, column, other, key, problem in REFERENCES:
        known = bundle[other].select(F.col(key).alias(column)).distinct()
        rows.append(found(bundle[name].where(F.col(column).isNotNull()).join(known, column, "left_anti"), problem, OWN[name]))
    return together(rows)


def misplaced(bundle: Mapping[str, DataFrame]) -> DataFrame:
    """Chunks, evidence and spans that aren't the exact text at their place, or of another document, or without a location.

    The places of all three in the sections' texts are cut together.
    """
    chunks, evidence, spans = bundle["chunks"], bundle["evidence"], bundle["spans"].where("source_end is not null")
    sections = bundle["sections"].dropDuplicates(["section"])
    place = lambda t: t.select("section", "start", "end")
    cut = pieces(place(chunks).unionByName(place(evidence)).unionByName(place(spans)), sections, "section")
    owner = sections.select("section", F.col("version").alias("owner"))
    at = ["section", "start", "end"]
    none = F.coalesce(F.size("locations"), F.lit(0)) <= 0
    bad = lambda own: ~F.col("piece").eqNullSafe(F.col(own)) | F.col("piece").isNull() | ~F.col("version").eqNullSafe(F.col("owner")) | none
    of_chunks = found(chunks.join(cut, at).join(owner, "section").where(bad("text")), "chunk is not its section's text", "chunk")
    of_evidence = found(evidence.join(cut, at).join(owner, "section").where(bad("quote")), "evidence is not its section's text", "edge")
    sources = pieces(spans.select("block", F.col("source_start").alias("start"), F.col("source_end").alias("end")), bundle["blocks"].dropDuplicates(["block"]), "block")
    sources = sources.select("block", F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.sha2("piece", 256).alias("source"))
    both = spans.join(cut.select(*at, F.sha2("piece", 256).alias("own")), at).join(sources, ["block", "source_start", "source_end"])
    of_spans = found(both.where("not own <=> source or own is null or source is null"), "span is not its block's text", "section")
    return together((of_chunks, of_evidence, of_spans))


def unproved(bundle: Mapping[str, DataFrame]) -> DataFrame:
    """Edges whose evidence or review is wanting, and evidence whose link isn't among its document's links."""
    blank = F.coalesce(F.regexp_replace("quote", r"^\s+|\s+$", "") == "", F.lit(True))
    proof = bundle["evidence"].groupBy("edge").agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    edges = bundle["edges"].join(proof, "edge", "left")
    quotes = F.when(F.col("n") > 0, F.array(F.when(F.col("blank") == 0, "x").otherwise("")))  # one quote stands for all
    wrong = relation_problem(F.col("relation"), quotes, F.col("conditions"), F.col("reviewer"), F.col("day"))
    of_edges = found(edges.withColumn("wrong", wrong).where("wrong is not null"), F.concat(F.lit("edge: "), "wrong"), "edge")
    linked = bundle["evidence"].where("link_target is not null").select("edge", "version", F.col("link_target").alias("target"), F.explode("locations").alias("location"))
    lost = linked.join(bundle["links"].select("version", "target", "location").distinct(), ["version", "target", "location"], "left_anti").select("edge").distinct()
    return of_edges.unionByName(found(lost, "link is not in its document", "edge"))


def problems(bundle: Mapping[str, DataFrame]) -> DataFrame:
    """(problem, key): everything in which a bundle's tables don't fit together; none for a sound one."""
    return together((repeated(bundle), missing(bundle), misplaced(bundle), unproved(bundle)))


def unowned(evidence: DataFrame, chunks: DataFrame, width: int = 1024) -> DataFrame:
    """The rows of evidence (section, start, end) that no chunk (section, start, end) of their section holds wholly.

    Both meet on stretches of `width` characters: a chunk is listed for each that it touches, evidence for the one where
    it begins, so a long section is many keys.
    """
    listed = chunks.select(F.col("section").alias("s"), F.col("start").alias("a"), F.col("end").alias("b"))
    listed = listed.where("b > a").withColumn("stretch", F.explode(F.sequence(F.expr(f"a div {width}"), F.expr(f"(b - 1) div {width}"))))
    own = (F.col("section") == F.col("s")) & (F.expr(f"start div {width}") == F.col("stretch")) & (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end"))
    return evidence.join(listed, own, "left_anti")


def summary(bundle: Mapping[str, DataFrame], warnings: DataFrame) -> DataFrame:
    """One row: the number of documents, sections, tables, chunks, nodes, edges, overrides, documents by status, and warnings."""
    of = lambda status: F.count_if(F.col("status") == status)
    rows = [
        bundle["documents"].agg(F.count("*").alias("documents"), of("active").alias("active_documents"), of("archived").alias("archived_documents"), of("review").alias("documents_needing_review")),
        bundle["edges"].agg(F.count("*").alias("graph_edges"), F.count_if(F.col("relation") == "overrides").alias("overrides")), bundle["blocks"].agg(F.count_if(F.col("kind") == "table").alias("tables")),
        *(t.agg(F.count("*").alias(name)) for name, t in (("sections", bundle["sections"]), ("chunks", bundle["chunks"]), ("graph_nodes", bundle["nodes"]), ("warnings", warnings))),
    ]
    return reduce(DataFrame.crossJoin, rows)  # of single rows
