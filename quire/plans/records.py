"""Queries over versions, scopes, graphs, events and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import evaluation as ev
from quire.operators import graph as gr
from quire.operators import mentions as mn
from quire.operators import versions as vs
from quire.plans.tables import table
from quire.sources import generations as gn


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a classification and a status that follow from source and doc_id."""
    n = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    kind = F.when(n % 3 == 0, "public").when(n % 3 == 1, "internal").otherwise("restricted")
    state = F.when(F.col("doc_id") % 5 == 0, "review").when(F.col("doc_id") % 5 == 1, "archived").otherwise("active")
    return table(spark, sf_dir, "documents").withColumns({"classification": kind, "status": state})


def dedup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.first_versions(table(spark, sf_dir, "documents"))


def version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vs.first_versions(table(spark, sf_dir, "documents"))
    zero = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    own = F.when(F.col("doc_id") % 3 == 0, F.col("sha")).otherwise(zero)
    m = v.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "active").otherwise("review").alias("review"), own.alias("reviewed_sha"), F.when(F.col("doc_id") % 11 == 0, F.array("sha")).alias("archived"))
    return vs.status(v.select("doc_id", "sha"), m).groupBy("status", "error").agg(F.count("*").alias("n"))


def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vs.first_versions(table(spark, sf_dir, "documents")).select("doc_id", "version_id").withColumn("status", F.lit("active"))
    return vs.retained(v.where("doc_id % 4 <> 0"), v.where("doc_id % 3 <> 0")).select("doc_id", "status")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return vs.latest([o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))], "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of documents and characters that each scope sees."""
    out = None
    for name, classes, review, archived in (("public", ["public"], False, False), ("staff", ["public", "internal"], False, False), ("reviewer", ["public", "internal"], True, False), ("all", list(vs.CLASSES), True, True)):
        part = docs(spark, sf_dir).where(vs.permitted(classes, review, archived)).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(name).alias("scope"), "n", "chars")
        out = part if out is None else out.unionByName(part)
    return out


def scoped_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a scope's view of documents, their lines as sections, and a graph of documents in the order of ids."""
    d = docs(spark, sf_dir)
    sections = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    nodes = d.select(F.col("doc_id").alias("node_id"), "doc_id", "classification", "status")
    edges = d.select(F.col("doc_id").alias("source"), (F.col("doc_id") + F.lit(3)).alias("target"))
    seen = vs.snapshot(d, sections, nodes, edges, vs.permitted(["public", "internal"], True, False))
    out = None
    for name, t in seen.items():
        part = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(vs.CLEARANCES), "clearance string, classes string")
    users = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 < 4, F.element_at(F.array(*(F.lit(c) for c, _ in vs.CLEARANCES)), (F.col("c_custkey") % 6 + 1).cast("int"))).otherwise("PUBLIC").alias("clearance"), (F.col("c_custkey") % 10 != 0).alias("approved"))
    return vs.clearance(users, known).select("c_custkey", F.array_join("classes", ",").alias("classes"), "error")


def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("Bad Id "), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("doc-"), (F.col("s_suppkey") % 40).cast("string"))).alias("id"),
        F.concat(F.lit("File_"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".PDF")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("review").alias("review"),
        F.when(F.col("s_suppkey") % 3 != 0, "reviewer").alias("reviewer"),
        F.when(F.col("s_suppkey") % 4 == 0, "xyz").when(F.col("s_suppkey") % 4 == 1, F.sha2(F.col("s_name").cast("binary"), 256)).alias("sha"),
    )
    return vs.manifest_problems(s)


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 characters of each document, some of them spoilt, against the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = F.col("k") * 100
    cut = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 100).cast("int") - 1, F.lit(0)))).alias("k"))
    moved = F.when((F.col("doc_id") + F.col("k")) % 97 == 0, 1).otherwise(0)
    chunks = cut.select(F.when(F.col("doc_id") % 50 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), start.alias("start"), F.when((F.col("doc_id") + F.col("k")) % 89 == 0, start + 1_000_000).otherwise(F.least(start + 100, F.length("text"))).alias("end"), F.substring("text", start + 1 + moved, F.lit(100)).alias("text"))
    return vs.problems(d, chunks)


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    lines = d.select(F.explode(F.split("text", "\n")).alias("line"))
    return d.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("status") == "archived").alias("archived"), F.count_if(F.col("classification") == "public").alias("public")).crossJoin(
        lines.agg(F.count("*").alias("sections"), F.count_if(F.col("line").contains("|")).alias("tables"))
    )


def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the quality label that a lookup by id gives, or a default."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("tag"))
    return table(spark, sf_dir, "documents").join(lab, "doc_id", "left").groupBy("lang", F.coalesce("tag", F.lit("General Policy")).alias("tag")).agg(F.count("*").alias("n"))


def enrich_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a header, and the enrichment that is stored under their SHA-1."""
    d = table(spark, sf_dir, "documents")
    store = d.where("doc_id % 3 = 0").select(F.sha1(F.col("text").cast("binary")).alias("key"), F.concat(F.lit("about "), F.col("lang")).alias("note")).groupBy("key").agg(F.min("note").alias("note"))
    out = d.withColumn("key", F.sha1(F.col("text").cast("binary"))).join(store, "key", "left")
    body = F.concat(F.lit("["), "source", F.lit(" | "), "lang", F.lit("]\n"), F.coalesce(F.concat("note", F.lit("\n")), F.lit("")), F.col("text"))
    return out.select("doc_id", "key", body.alias("text"))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


# ---- graph -----------------------------------------------------------------------------------------------------------


def bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edges = n.select(name("region", "n_regionkey").alias("source"), name("nation", "n_nationkey").alias("target"))
    for t, kind, key, nation in ((c, "customer", "c_custkey", "c_nationkey"), (s, "supplier", "s_suppkey", "s_nationkey")):
        edges = edges.unionByName(t.select(name("nation", nation).alias("source"), name(kind, key).alias("target")))
    return gr.walk(table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("node")), edges, 2)


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that walks of three hops from regions follow, and how many; every ninth customer is only overridden."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    kind = F.when(F.col("c_custkey") % 9 == 0, "overrides").otherwise("references")
    edges = n.select(name("region", "n_regionkey").alias("source"), name("nation", "n_nationkey").alias("target"), F.lit("contains").alias("relation"))
    edges = edges.unionByName(c.select(name("nation", "c_nationkey").alias("source"), name("customer", "c_custkey").alias("target"), kind.alias("relation")))
    edges = edges.unionByName(o.select(name("customer", "o_custkey").alias("source"), name("order", "o_orderkey").alias("target"), F.lit("references").alias("relation")))
    seen = gr.walk(table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("node")), edges, 3)
    return gr.walked_edges(seen, edges, 3).groupBy("start", "relation").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of customers whose parent is the customer with half their key; every fiftieth is on a cycle."""
    parent = F.when(F.col("c_custkey") <= 1, None).when(F.col("c_custkey") % 50 == 0, F.col("c_custkey")).otherwise(F.expr("c_custkey div 2"))
    return gr.levels(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), parent.alias("parent")))


def hyperlink_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.hyperlinks(table(spark, sf_dir, "pages"))


def legal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in texts that are made from parts: some name a regulation."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("See far  "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-4").otherwise(""), F.lit(" and 2 cfr 200."), (F.col("p_partkey") % 5).cast("string"), F.lit(", FAR part."))
    return gr.legal_references(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by brand and type names between parts."""
    p = table(spark, sf_dir, "part")
    texts = p.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" of "), "p_brand", F.lit(", "), "p_type").alias("text"))
    names = p.groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_partkey").alias("target")).unionByName(p.groupBy(F.col("p_type").alias("alias")).agg(F.min("p_partkey").alias("target")))
    return gr.alias_references(texts, names.select(F.col("target").cast("long").alias("target"), "alias"))


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a collection that is built anew, numbered through in an order: the id is chunk_ and the number."""
    rows = gn.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return rows.select("doc_id", F.concat(F.lit("chunk_"), F.col("number").cast("string")).alias("id"))


def owned_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as sections, chunks that overlap or leave gaps, and two aliases of every seventh document: its fourth and fifth word, and its seventh."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("section"), F.col("doc_id").alias("owner"), "text")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length(text) - 1) div 300"))).alias("k")
    chunks = d.select("section", F.length("text").alias("n"), starts).where("(section + k) % 4 <> 0")
    chunks = chunks.select("section", (F.col("k") * 300).cast("int").alias("start"), F.least(F.col("k") * 300 + F.when(F.col("k") % 3 == 0, 340).otherwise(250), F.col("n")).cast("int").alias("end")).where("end > start")
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    first = tx.let(words(F.left("text", F.lit(400))), lambda w: F.when(F.size(w) > 7, w).otherwise(words(F.col("text"))))  # the last word of a beginning may be cut
    two = lambda w: F.when((F.size(w) > 6) & (w[3] != w[4]), F.array(F.concat(w[3], F.lit("-"), w[4]), w[6]))
    names = d.where("owner % 7 = 0").select(F.col("owner").alias("target"), F.explode(tx.let(first, two)).alias("alias"))
    return d, chunks, names.groupBy("alias").agg(F.min("target").alias("target"))


def owned_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents name of one another in the ranges that their chunks own, with places and quotes."""
    return mn.references(*owned_sections(spark, sf_dir))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, the text of a page being a block that two sections hold a part of each; chunks of 400 characters."""
    p = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", "<[^>]*>", " ")
    blocks = p.select(F.col("page_id").alias("block"), text.alias("text"))
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]+)">[^<]*</a>'), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit('<a href="[^"]+">([^<]*)</a>'), F.lit(1)).alias("label"))
    links = p.select(F.col("page_id").alias("block"), F.posexplode(hits).alias("n", "x")).select("block", "x.label", F.when(F.col("n") % 3 == 2, F.col("x.target")).otherwise(F.concat(F.lit("https://example.org/"), F.col("n").cast("string"))).alias("target"))
    half = F.expr("length(text) div 2").cast("int")
    spans = blocks.select("block", F.explode(F.array(F.struct((F.col("block") * 2).alias("section"), F.lit(0).alias("start"), F.lit(0).alias("source_start"), half.alias("source_end")), F.struct((F.col("block") * 2 + 1).alias("section"), F.lit(10).alias("start"), half.alias("source_start"), F.lit(None).cast("int").alias("source_end")))).alias("s")).select("block", "s.*")
    chunks = spans.select("section", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("k")).select("section", (F.col("k") * 500).alias("start"), (F.col("k") * 500 + 400).alias("end"))
    return mn.link_references(spans, blocks, links, chunks)


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, heading, number of paragraphs and of links of each page; missing ones are null."""
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", first(r"<title>([^<]*)</title>").alias("title"), first(r"<h1>([^<]*)</h1>").alias("heading"), count(r"<p>").alias("paragraphs"), count(r"<a href=").alias("links"))


# ---- answers and events -------------------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with amounts and citations that follow from orders; some amounts and references have no evidence."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    amount = tx.money(cents / 100)
    other = tx.money((cents + F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(0)) / 100)
    answer = F.concat(F.lit("The limit is "), amount, F.lit(" ["), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("] and $15,000 [2]."))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Is "), amount, F.lit(" fine?")).alias("question"), answer.alias("answer"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("refs"), F.concat(F.lit("up to "), other, F.when(F.col("o_orderkey") % 2 == 0, " or $15,000.00").otherwise("")).alias("evidence"))


def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.grounding(answers(spark, sf_dir)).select("id", F.col("citations").cast("int").alias("citations"), "invalid_refs", "unmatched", "question_only", "review")


def numeric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return a.select("id", ev.numeric_grade(F.concat("evidence", F.lit(" and 100,000")), F.col("answer")).alias("grade"))


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    k = F.col("conv_id") + F.col("turn")
    text = F.concat(F.when(k % 7 == 0, "<think>").when(k % 7 == 1, "Let me check. ").when(k % 7 == 2, "[cite the policy] [citation needed] [insert citation]").when(k % 7 == 3, "[1] ").otherwise(""), F.when(k % 11 == 0, "Cannot determine. ").otherwise(""), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", ev.diagnostics(text).alias("flags"))


def diagnostic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("conv_id", "turn", F.array_join("flags", ";").alias("flags"))


def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(diagnosed(spark, sf_dir))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.count_if(F.col("value") > 100).alias("slow"))


def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by a judge's replies that follow from the labels."""
    k = F.col("doc_id") % 6
    reply = F.when(k == 0, "INCORRECT").when(k == 1, "partially: PARTIAL").when(k == 2, "").when(k == 3, "ERROR: time").otherwise("Correct.")
    return table(spark, sf_dir, "labels").groupBy(ev.judged(reply).alias("grade"), "quality").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tx.hash_bucket(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), (b < 5).alias("held_out"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return a.select("id", F.array_join(F.transform(tx.dollar_amounts(F.concat("answer", F.lit(" "), "evidence")), tx.money), ";").alias("amounts"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.element_at(F.array(*map(F.lit, ["two weeks", "90 days", "Twelve months", "a year", "6-week", "three  days"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.duration_days(F.concat(F.lit("for "), w, F.lit(" from now"))).alias("days"))


def date_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    text = F.concat(F.lit("Effective date: "), F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.date_format(d, "M.d.yyyy")).when(k == 3, F.date_format(d, "MM/yyyy")).otherwise("13/45/2020"), F.lit(" by the board"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.labelled_date(text, r"effective\s+date").alias("effective"))


def quote_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered quotes of 20 characters or more, from the sentences of the benchmark's passages."""
    parts = F.filter(F.transform(F.split("text", r"[.\n]"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("k", "quote")).select("item_id", (F.col("k") + 1).alias("k"), "quote")


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("It is so"), F.when(F.col("o_orderkey") % 5 == 0, " [1]").otherwise("")).alias("text"), F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("o_orderkey") % 4).cast("int"), F.lit(1))).alias("quotes"), F.lit(2).alias("n_quotes"))
    return ev.claims(rows).groupBy("problem").agg(F.count("*").alias("n"))


def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 70 % of English documents and 30 % of others, chosen by a hash of the id, and a seventh of them for evaluation; a sampling operator."""
    digits = lambda a: F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), a, 4), 16, 10).cast("int")
    rate = F.when(F.col("lang") == "en", 45875).otherwise(19660)  # of 65536
    return table(spark, sf_dir, "documents").where(digits(1) < rate).select("doc_id", "lang", (digits(5) < 9830).alias("evaluation"))


def sql() -> dict[str, str]:
    d = "d AS (SELECT *, CASE CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS classification, CASE doc_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'archived' ELSE 'active' END AS status FROM documents)"
    v = "v AS (SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) - 1 AS copies, max(doc_id) AS last_copy FROM documents GROUP BY 1)"
    scope = lambda name, where: f"SELECT '{name}' AS scope, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM d WHERE {where}"
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    money = lambda x: f"'$' || format('{{:,.2f}}', {x})"
    ans = f"""a AS (SELECT o_orderkey AS id, 'Is ' || {money(cents + ' / 100')} || ' fine?' AS question, 'The limit is ' || {money(cents + ' / 100')} || ' [' || (o_orderkey % 4 + 1) || '] and $15,000 [2].' AS answer,
      'up to ' || {money('(' + cents + ' + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END) / 100')} || CASE WHEN o_orderkey % 2 = 0 THEN ' or $15,000.00' ELSE '' END AS evidence FROM orders)"""
    found = lambda c: f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '\\$\\s*([\\d,]+(?:\\.\\d+)?)', 1), lambda x: replace(x, ',', '')::DOUBLE)))"
    listed = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda y: {money('y')}), ';')"
    rep = lambda x: x.replace("\\", "\\")
    flags = f"""list_filter([CASE WHEN NOT regexp_matches(t, '\\S') THEN 'empty_answer' END, CASE WHEN regexp_matches(t, '^\\s*ERROR:') THEN 'error_response' END, CASE WHEN regexp_matches(t, '(?i)</?think>') THEN 'thinking_marker_present' END,
      CASE WHEN regexp_matches(t, '{rep(ev.LEAK)}') THEN 'possible_reasoning_leakage' END, CASE WHEN regexp_matches(t, '{rep(ev.PLACEHOLDER)}') THEN 'placeholder_citation_present' END, CASE WHEN len(regexp_extract_all(t, '{rep(ev.PLACEHOLDER)}')) >= 3 THEN 'repeated_placeholder_citations' END,
      CASE WHEN NOT regexp_matches(t, '\\[\\d+\\]') THEN 'no_numbered_citation' END, CASE WHEN regexp_matches(t, '{rep(ev.UNSURE)}') THEN 'uncertainty_or_refusal_phrase' END, CASE WHEN length(t) > 2000 THEN 'long_answer_over_2000_chars' END], lambda x: x IS NOT NULL)"""
    diag = "c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN '<think>' WHEN 1 THEN 'Let me check. ' WHEN 2 THEN '[cite the policy] [citation needed] [insert citation]' WHEN 3 THEN '[1] ' ELSE '' END || CASE WHEN (conv_id + turn) % 11 = 0 THEN 'Cannot determine. ' ELSE '' END || coalesce(text, '') AS t FROM conversations WHERE role = 'assistant')"
    hexes = "list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(text), i, 1)) - 1)"
    link = '<a href="([^"]+)">[^<]*</a>'
    label = '<a href="[^"]+">([^<]*)</a>'
    return {
        "dedup_versions": f"WITH {v} SELECT sha, doc_id, copies, last_copy, 'document:' || doc_id || ':' || sha AS version_id FROM v",
        "version_status": f"WITH {v}, m AS (SELECT *, doc_id % 7 <> 0 AS reg, CASE WHEN doc_id % 2 = 0 THEN 'active' ELSE 'review' END AS review, CASE WHEN doc_id % 3 = 0 THEN sha ELSE sha256(doc_id::VARCHAR) END AS rsha, doc_id % 11 = 0 AS arch FROM v) SELECT CASE WHEN NOT reg THEN NULL WHEN arch THEN 'archived' ELSE review END AS status, CASE WHEN NOT reg THEN 'unregistered' WHEN review = 'active' AND rsha <> sha AND NOT arch THEN 'hash differs' END AS error, count(*) AS n FROM m GROUP BY 1, 2",
        "archive_merge": f"WITH {v} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'active' ELSE 'archived' END AS status FROM v WHERE doc_id % 3 <> 0 OR doc_id % 4 <> 0",
        "latest_rows": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1",
        "scope_filter": f"WITH {d} " + " UNION ALL ".join((scope("public", "classification = 'public' AND status = 'active'"), scope("staff", "classification IN ('public', 'internal') AND status = 'active'"), scope("reviewer", "classification IN ('public', 'internal') AND status IN ('active', 'review')"), scope("all", "TRUE"))),
        "scoped_snapshot": f"WITH {d}, s AS (SELECT * FROM d WHERE classification IN ('public', 'internal') AND status IN ('active', 'review')) SELECT 'documents' AS part, count(*) AS n FROM s UNION ALL SELECT 'sections', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM s UNION ALL SELECT 'nodes', count(*) FROM s UNION ALL SELECT 'edges', count(*) FROM s a JOIN s b ON b.doc_id = a.doc_id + 3",
        "clearances": "SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'public,internal' WHEN 2 THEN 'public,internal' WHEN 3 THEN 'public,internal,restricted' ELSE 'public' END AS classes, CASE WHEN c_custkey % 10 = 0 THEN 'not approved' END AS error FROM customer",
        "manifest_checks": r"""WITH m AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'Bad Id ' || s_suppkey ELSE 'doc-' || (s_suppkey % 40) END AS id, 'File_' || (s_suppkey % 30) || '.PDF' AS name, s_suppkey % 2 = 0 AS act, s_suppkey % 3 <> 0 AS rev, CASE s_suppkey % 4 WHEN 0 THEN 'xyz' WHEN 1 THEN sha256(s_name) END AS sha FROM supplier)
          SELECT 'id' AS problem, id AS key, 1::BIGINT AS n FROM m WHERE NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*') UNION ALL SELECT 'hash', id, 1 FROM m WHERE sha IS NOT NULL AND NOT regexp_full_match(sha, '[0-9a-f]{64}') UNION ALL SELECT 'review', id, 1 FROM m WHERE act AND (NOT rev OR sha IS NULL)
          UNION ALL SELECT 'duplicate id', id, count(*) FROM m GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'ambiguous name', regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), count(*) FROM m GROUP BY 2 HAVING count(*) > 1""",
        "integrity_violations": """WITH c AS (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(length(text) / 100) AS BIGINT), 1))) AS k FROM documents), x AS (SELECT CASE WHEN doc_id % 50 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, k * 100 AS s, CASE WHEN (doc_id + k) % 89 = 0 THEN k * 100 + 1000000 ELSE least(k * 100 + 100, length(text)) END AS e, substr(text, k * 100 + 1 + CASE WHEN (doc_id + k) % 97 = 0 THEN 1 ELSE 0 END, 100) AS t FROM c),
          j AS (SELECT x.doc_id, CASE WHEN d.text IS NULL THEN 'no document' WHEN s < 0 OR e <= s OR e > length(d.text) THEN 'outside' WHEN substr(d.text, s + 1, e - s) <> t THEN 'differs' END AS problem FROM x LEFT JOIN documents d USING (doc_id)) SELECT problem, doc_id, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'repeated', doc_id, count(*) FROM documents GROUP BY 2 HAVING count(*) > 1""",
        "index_summary": f"WITH {d}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM d) SELECT count(*) AS documents, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'archived') AS archived, count(*) FILTER (classification = 'public') AS public, (SELECT count(*) FROM l) AS sections, (SELECT count(*) FROM l WHERE contains(line, '|')) AS tables FROM d",
        "tag_documents": "SELECT lang, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE 'General Policy' END AS tag, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
        "enrich_merge": "WITH s AS (SELECT sha1(text) AS key, min('about ' || lang) AS note FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT doc_id, sha1(text) AS key, '[' || source || ' | ' || lang || ']' || chr(10) || coalesce(note || chr(10), '') || text AS text FROM documents LEFT JOIN s ON s.key = sha1(documents.text)",
        "resume_todo": "SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
        "bfs_2hop": "WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier), w AS (SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node, 0 AS hop FROM region UNION ALL SELECT start, target, hop + 1 FROM w JOIN e ON node = source WHERE hop < 2) SELECT start, node, CAST(min(hop) AS INT) AS hop FROM w GROUP BY 1, 2",
        "walk_edges": "WITH e AS (SELECT n_regionkey AS r, 'contains' AS relation, 'nation:' || n_nationkey AS t FROM nation UNION ALL SELECT n_regionkey, 'references', 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0 UNION ALL SELECT n_regionkey, 'references', 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0) SELECT 'region:' || r AS start, relation, count(*) AS edges, count(DISTINCT t) AS targets FROM e GROUP BY 1, 2",
        "tree_levels": "WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey <= 1 THEN NULL WHEN c_custkey % 50 = 0 THEN c_custkey ELSE c_custkey // 2 END AS parent FROM customer), w AS (SELECT node, 0 AS level FROM p WHERE parent IS NULL UNION ALL SELECT p.node, level + 1 FROM p JOIN w ON p.parent = w.node WHERE level < 100) SELECT p.node, CAST(level AS INT) AS level FROM p LEFT JOIN w USING (node)",
        "hyperlink_refs": f"WITH r AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{link}', 1)) AS target, unnest(regexp_extract_all(html, '{label}', 1)) AS label FROM pages), o AS (SELECT page_id, label FROM r GROUP BY 1, 2 HAVING count(*) = 1 AND trim(label) <> ''), f AS (SELECT page_id, label, CASE WHEN regexp_matches(target, '^https?://') THEN target WHEN starts_with(target, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || target END AS target FROM r) SELECT page_id, target, label FROM f JOIN o USING (page_id, label) WHERE target IS NOT NULL",
        "legal_refs": r"WITH t AS (SELECT p_partkey AS doc_id, 'See far  ' || p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 2 = 0 THEN '-4' ELSE '' END || ' and 2 cfr 200.' || (p_partkey % 5) || ', FAR part.' AS text FROM part), f AS (SELECT doc_id, regexp_replace(upper(unnest(regexp_extract_all(text, '(?i)\b(FAR\s+\d+\.\d+(?:-\d+)?|\d+\s+CFR\s+\d+(?:\.\d+)?)\b', 1))), '\s+', ' ', 'g') AS reference FROM t) SELECT doc_id, reference, count(*) AS n, 'reference:' || substr(sha256(reference), 1, 20) AS node_id FROM f GROUP BY 1, 2",
        "html_extract": "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a href=')) AS links FROM pages",
        "answer_grounding": f"WITH {ans}, b AS (SELECT id, list_sort(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))) AS refs, {found('answer')} AS sa, {found('evidence')} AS kn, {found('question')} AS qu FROM a), c AS (SELECT id, CAST(len(refs) AS INT) AS citations, array_to_string(list_filter(refs, lambda r: r NOT IN ('1', '2', '3')), ';') AS invalid_refs, {listed('list_filter(sa, lambda y: NOT list_contains(kn, y))')} AS unmatched, {listed('list_filter(sa, lambda y: list_contains(qu, y) AND NOT list_contains(kn, y))')} AS question_only FROM b) SELECT *, invalid_refs <> '' OR unmatched <> '' AS review FROM c",
        "numeric_score": f"WITH {ans}, b AS (SELECT id, list_distinct(list_transform(regexp_extract_all(evidence || ' and 100,000', '(\\d[\\d,]{{3,}})', 1), lambda x: replace(x, ',', ''))) AS ns, replace(answer, ',', '') AS p FROM a), c AS (SELECT id, len(list_filter(ns, lambda x: contains(p, x))) / len(ns) AS share FROM b) SELECT id, CASE WHEN share >= 0.8 THEN 'correct' WHEN share >= 0.4 THEN 'partial' ELSE 'wrong' END AS grade FROM c",
        "diagnostic_flags": f"WITH {diag} SELECT conv_id, turn, array_to_string({flags}, ';') AS flags FROM c",
        "flag_histogram": f"WITH {diag}, f AS (SELECT unnest({flags}) AS flag FROM c) SELECT flag, count(*) AS n FROM f GROUP BY 1",
        "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) FILTER (value > 100) AS slow FROM events GROUP BY 1",
        "grade_counts": "SELECT CASE doc_id % 6 WHEN 0 THEN 'wrong' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' WHEN 3 THEN 'wrong' ELSE 'correct' END AS grade, quality, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY 1, 2",
        "holdout_split": f"WITH b AS (SELECT doc_id, CAST(list_reduce({hexes}, lambda a, x: (a * 16 + x) % 100, 0) AS INT) AS bucket FROM documents) SELECT doc_id, bucket, bucket < 5 AS held_out FROM b",
        "amounts": f"WITH {ans} SELECT id, {listed(found(chr(40) + 'answer || chr(32) || evidence' + chr(41)))} AS amounts FROM a",
        "durations": "SELECT o_orderkey, CAST(([14, 90, 360, NULL, 42, 3])[o_orderkey % 6 + 1] AS INT) AS days FROM orders",
        "date_observations": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m') END AS effective FROM orders",
        "quote_partition": "WITH p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda s: trim(s)), lambda s: length(s) >= 20) AS q FROM benchmark) SELECT item_id, CAST(generate_subscripts(q, 1) AS INT) AS k, unnest(q) AS quote FROM p",
        "sample_stratified": "WITH h AS (SELECT doc_id, lang, md5(doc_id::VARCHAR) AS h FROM documents) SELECT doc_id, lang, ('0x' || substr(h, 5, 4))::INT < 9830 AS evaluation FROM h WHERE ('0x' || substr(h, 1, 4))::INT < CASE WHEN lang = 'en' THEN 45875 ELSE 19660 END",
        "numbered_rows": "SELECT doc_id, 'chunk_' || (row_number() OVER (ORDER BY lang, doc_id) - 1) AS id FROM documents",
        "owned_references": r"""WITH RECURSIVE c AS (SELECT doc_id AS section, text, length(text) AS n, unnest(range((length(text) - 1) // 300 + 1)) AS k FROM documents WHERE text <> ''),
          r AS (SELECT section, k * 300 AS a, least(k * 300 + CASE WHEN k % 3 = 0 THEN 340 ELSE 250 END, n) AS b FROM c WHERE (section + k) % 4 <> 0),
          i AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY section ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r WHERE b > a),
          m AS (SELECT section, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY section ORDER BY a, b) AS g FROM i) GROUP BY section, g),
          p AS (SELECT section, a AS pos, substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) AS piece, row_number() OVER () AS id FROM m JOIN documents ON doc_id = section),
          s AS (SELECT id, section, pos, piece, regexp_extract_all(piece, '[\p{L}\p{N}]+') AS tok, regexp_split_to_array(piece, '[\p{L}\p{N}]+') AS sep FROM p),
          u AS (SELECT id, section, pos, piece, unnest(tok) AS w, generate_subscripts(tok, 1) AS k, unnest(sep[1:len(tok)]) AS before, unnest(sep[2:]) AS after FROM s),
          t AS (SELECT *, sum(length(before)) OVER o + sum(length(w)) OVER o - length(w) AS a, lower(w) AS lo, lead(lower(w)) OVER o AS lo2 FROM u WINDOW o AS (PARTITION BY id ORDER BY k)),
          t2 AS (SELECT *, a + length(w) AS b, lead(a + length(w)) OVER o AS b2, lead(after) OVER o AS after2 FROM t WINDOW o AS (PARTITION BY id ORDER BY k)),
          w AS (SELECT doc_id AS target, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents WHERE text <> '' AND doc_id % 7 = 0),
          n AS (SELECT alias, min(target) AS target FROM (SELECT target, unnest([w[4] || '-' || w[5], w[7]]) AS alias FROM w WHERE len(w) > 6 AND w[4] <> w[5]) GROUP BY 1),
          n2 AS (SELECT *, split_part(alias, '-', 1) AS x, split_part(alias, '-', 2) AS y FROM n),
          h0 AS (SELECT id, section, pos, piece, target, alias, a, b, [k] AS toks, before, after FROM t2 JOIN n2 ON lo = x || y UNION ALL SELECT id, section, pos, piece, target, alias, a, b2, [k, k + 1], before, after2 FROM t2 JOIN n2 ON lo = x AND lo2 = y AND y <> ''),
          h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -length(alias), target, alias, a) AS rank FROM h0 WHERE NOT ends_with(before, '_') AND NOT starts_with(after, '_')),
          g AS (SELECT DISTINCT id, 0::BIGINT AS k, []::BIGINT[] AS taken, FALSE AS ok FROM h UNION ALL SELECT g.id, g.k + 1, CASE WHEN list_has_any(taken, toks) THEN taken ELSE list_concat(taken, toks) END, NOT list_has_any(taken, toks) FROM g JOIN h ON h.id = g.id AND h.rank = g.k + 1),
          e AS (SELECT section AS source, target, 'references' AS relation, CAST(pos + a AS INT) AS start, CAST(pos + b AS INT) AS "end", substr(piece, (a + 1)::BIGINT, (b - a)::BIGINT) AS quote FROM h JOIN g ON g.id = h.id AND g.k = h.rank WHERE ok AND section <> target)
          SELECT 'edge:' || substr(sha256(source || ':' || target || ':references:' || source || ':' || start || ':' || "end"), 1, 24) AS edge_id, * FROM e""",
        "page_links": r"""WITH b AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, regexp_extract_all(html, '<a href="([^"]+)">[^<]*</a>', 1) AS ts, regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1) AS ls FROM pages),
          l AS (SELECT page_id, text, unnest(ls) AS label, unnest(ts) AS href, generate_subscripts(ls, 1) - 1 AS n FROM b), k AS (SELECT *, CASE WHEN n % 3 = 2 THEN href ELSE 'https://example.org/' || n END AS target, array_to_string(list_transform(regexp_split_to_array(regexp_replace(label, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: regexp_escape(x)), '\s+') AS pat FROM l WHERE trim(label) <> ''),
          o AS (SELECT page_id, label, target, length(text) // 2 AS half, length(regexp_split_to_array(text, pat)[1]) AS a, length(regexp_extract(text, pat)) AS m FROM k WHERE regexp_matches(target, '(?i)^https?:') AND len(regexp_extract_all(text, pat)) = 1),
          z AS (SELECT page_id * 2 AS source, target, label, a AS start, a + m AS "end" FROM o WHERE a + m <= half UNION ALL SELECT page_id * 2 + 1, target, label, a + 10 - half, a + m + 10 - half FROM o WHERE a >= half)
          SELECT source, target, label, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM z WHERE start // 500 = ("end" - 1) // 500 AND "end" - start // 500 * 500 <= 400""",
        "claim_checks": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'no support' WHEN o_orderkey % 4 IN (0, 3) THEN 'unknown quote' WHEN o_orderkey % 5 = 0 THEN 'own citation' END AS problem, count(*) AS n FROM orders GROUP BY 1",
    }


NAMES = (
    "dedup_versions version_status archive_merge latest_rows scope_filter scoped_snapshot clearances manifest_checks integrity_violations index_summary tag_documents enrich_merge resume_todo "
    "bfs_2hop walk_edges tree_levels hyperlink_refs legal_refs numbered_rows reference_edges owned_references page_links html_extract answer_grounding numeric_score diagnostic_flags flag_histogram latency_summary grade_counts holdout_split amounts durations "
    "date_observations quote_partition claim_checks sample_stratified"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
