"""Evidence graph: references between documents, bounded walks, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.mentions import mentions
from quire.scratch import forget, saved


def steps(edges: DataFrame) -> DataFrame:
    """edges without overrides, whose conditions a walk can't judge."""
    return edges.where("relation <> 'overrides'") if "relation" in edges.columns else edges


def walk(starts: DataFrame, edges: DataFrame, hops: int = 10) -> DataFrame:
    """(start, node, hop): the nodes within some hops of each start, with the least number of hops. edges: (source, target), and relation, of which overrides are skipped.

    A round for each hop: its new nodes are written and met with the edges, and a round without new nodes is the last,
    so the plan of a round doesn't hold the earlier ones and cycles end the walk.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    known = steps(edges).select("source", "target")
    front = saved(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct())
    seen = front
    for hop in range(1, hops + 1):
        new = front.join(known, front["node"] == known["source"]).select("start", F.col("target").alias("node")).distinct()
        front = saved(new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            forget(front)
            break
        seen = seen.unionByName(front)
    return seen


def walked_edges(seen: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(start, *edges): the edges that a walk of some hops followed, those from nodes that it reached before its last hop."""
    known = steps(edges)
    return seen.where(F.col("hop") < hops).select("start", F.col("node").alias("source")).join(known, "source").select("start", *known.columns)


def levels(parents: DataFrame) -> DataFrame:
    """(node, level) for (node, parent), each node once, roots at 0; nodes that no root leads to have null: they are on or below a cycle.

    Each round doubles the steps that a node looks up, so there are about log2(depth) joins. A round in which no node
    gets to its end is the last: there are nodes at every level above the deepest, and the rest never get to one.
    """
    open_ = saved(parents.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("steps"), F.col("parent").isNull().alias("rooted")))
    done = open_.where("up is null")
    open_ = open_.where("up is not null")
    while True:
        above = open_.unionByName(done).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("rooted").alias("top"))
        met = open_.drop("rooted").join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("top", F.lit(False)).alias("rooted"))
        met = saved(met)
        ended = met.where("up is null")
        if ended.isEmpty():
            break
        done, open_ = done.unionByName(ended), met.where("up is not null")
    return done.select("node", F.when(F.col("rooted"), F.col("steps")).alias("level")).unionByName(open_.select("node", F.lit(None).cast("int").alias("level")))


def key(*parts: Column | str) -> Column:
    """The parts as text, with colons between."""
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def nodes(documents: DataFrame, sections: DataFrame, outside: DataFrame) -> DataFrame:
    """(node, kind, label, version, classification, status, properties): documents, forms, sections and references to what is outside.

    documents: (version, doc_id, title, kind, policy_id, classification, status), those of kind form give a form too;
    sections: (section, version, title, kind, ordinal); outside: (version, reference, uri), of which each is one node with
    its document's rights, named by a hash of both. A reference is never resolved to a document.
    """
    d, columns = documents, ("node", "kind", "label", "version", "classification", "status", "properties")
    props = lambda **of: F.create_map(*(x for k, v in of.items() for x in (F.lit(k), v.cast("string"))))
    of = lambda t, node, kind, label, properties: t.select(node.alias("node"), F.lit(kind).alias("kind"), label.alias("label"), "version", "classification", "status", properties.alias("properties")).select(*columns)
    version, rights = F.col("version"), d.select("version", "classification", "status")
    own = of(d, key("document", version), "document", F.col("title"), props(document_id=F.col("doc_id"), policy_id=F.col("policy_id"), kind=F.col("kind")))
    forms = of(d.where("kind = 'form'"), key("form", version), "form", F.col("title"), props(document_id=F.col("doc_id")))
    parts = of(sections.join(rights, "version"), key("section", F.col("section")), "section", F.col("title"), props(kind=F.col("kind"), ordinal=F.col("ordinal")))
    name = F.concat(F.lit("reference:"), F.substring(F.sha2(F.concat_ws(":", version.cast("string"), "reference").cast("binary"), 256), 1, 20))
    far = outside.groupBy("version", "reference").agg(F.min("uri").alias("uri")).join(rights, "version")
    return own.unionByName(forms).unionByName(parts).unionByName(of(far, name, "reference", F.col("reference"), props(resolved=F.lit("false"), uri=F.col("uri"))))


def containing(documents: DataFrame, sections: DataFrame, most: int = 160) -> DataFrame:
    """(source, target, relation, start, end, quote): each section (section, version, parent, kind, text) in its parent or its document, and each form's source, its document.

    The evidence is the section's first `most` characters; a form's is that of its document's first body section at the
    top, by ordinal.
    """
    end = F.least(F.length("text"), F.lit(most))
    quote = F.expr(f"substring(text, 1, {most})")
    source = F.when(F.col("parent").isNotNull(), key("section", F.col("parent"))).otherwise(key("document", F.col("version")))
    rows = lambda t, a, b, relation: t.select(a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), F.lit(0).alias("start"), end.alias("end"), quote.alias("quote"))
    held = rows(sections, source, key("section", F.col("section")), "contains")
    top = sections.where("parent is null and kind = 'body'").join(documents.where("kind = 'form'").select("version"), "version", "left_semi")
    first = top.groupBy("version").agg(F.min(F.struct("ordinal", "section", "text")).alias("x")).select("version", "x.text")
    return held.unionByName(rows(first, key("form", F.col("version")), key("document", F.col("version")), "has_source"))


LINK = r"<a href=\"([^\"]+)\">([^<]*)</a>"


def hyperlinks(pages: DataFrame) -> DataFrame:
    """(page_id, target, label) of the links to http(s) addresses or rooted paths with a label that occurs once in the page."""
    all_ = F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)">[^<]*</a>'), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(r'<a href="[^"]+">([^<]*)</a>'), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(all_.alias("target"), labels.alias("label"))).alias("k", "x")).select("page_id", "url", "x.target", "x.label")
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    full = F.when(F.col("target").rlike("^https?://"), F.col("target")).when(F.col("target").startswith("/"), F.concat(host, "target"))
    once = rows.groupBy("page_id", "label").agg(F.count("*").alias("n")).where("n = 1 and trim(label) <> ''").select("page_id", "label")
    return rows.withColumn("target", full).where("target is not null").join(once, ["page_id", "label"]).select("page_id", "target", "label")


LEGAL = r"(?i)\b(FAR\s+\d+\.\d+(?:-\d+)?|\d+\s+CFR\s+\d+(?:\.\d+)?)\b"


def legal_references(texts: DataFrame) -> DataFrame:
    """(doc_id, reference, node_id, n): regulations that a text names, in upper case with single spaces."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LEGAL), F.lit(1))).alias("raw"))
    name = F.regexp_replace(F.upper("raw"), r"\s+", " ")
    return found.select("doc_id", name.alias("reference")).groupBy("doc_id", "reference").agg(F.count("*").alias("n")).withColumn("node_id", F.concat(F.lit("reference:"), F.substring(F.sha2(F.col("reference").cast("binary"), 256), 1, 20)))


def alias_references(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, target, alias, at): every place, from 1, of whole-word aliases in texts, as mentions() finds them.

    A document's own aliases take their places too, but give no row.
    """
    found = mentions(texts.select(F.col("doc_id").alias("key"), "text"), aliases)
    return found.where("key <> target").select(F.col("key").alias("doc_id"), "target", "alias", (F.col("start") + 1).alias("at"))
