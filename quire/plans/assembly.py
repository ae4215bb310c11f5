"""Queries over evidence, claims, graph nodes, manifests, labels and carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import assembly as am
from quire.operators import catalog as ct
from quire.operators import evaluation as ev
from quire.operators import graph as gr
from quire.operators import retrieval as rt
from quire.operators import rules
from quire.operators import versions as vs
from quire.plans import corpus, records
from quire.plans.purchases import REQ, choose, decided, pick
from quire.plans.tables import table
from quire.scratch import saved, sized


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as blocks; every seventh is a footer, every eleventh in a part of footnotes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return d.withColumns({"kind": F.when(F.col("ordinal") % 7 == 6, "footer").otherwise("text"), "part": F.when(F.col("ordinal") % 11 == 10, "word/footnotes.xml")})


def body_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return am.body_positions(lines(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of each body line stands in each stretch of 300 characters of the body."""
    blocks = am.body_positions(lines(spark, sf_dir)).select("doc_id", F.col("ordinal").alias("block"), "start", "end")
    ends = blocks.groupBy("doc_id").agg(F.max("end").alias("n"))
    cut = ends.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 300"))).alias("section"))
    sections = cut.select("doc_id", "section", (F.col("section") * 300).alias("start"), F.least(F.col("section") * 300 + 300, F.col("n")).alias("end"))
    return am.clipped(sections, blocks).select("doc_id", "section", *(F.col(c).cast("long").alias(c) for c in ("block", "start", "end", "source_start", "source_end")))


def quote_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered quotes of documents whose lines are paragraphs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    each = d.select("doc_id", F.explode(am.quote_spans(F.col("t"), F.array().cast("array<int>"))).alias("s"))
    return each.select("doc_id", F.col("s.quote_id").cast("long").alias("quote_id"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.md5(F.col("s.quote").cast("binary")).alias("digest"))


def claim_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k, cents = F.col("o_orderkey") % 8, F.floor("o_totalprice")
    money = F.format_number(cents, 0)
    passages = o.select(F.col("o_orderkey").alias("q_id"), F.lit(1).alias("source_id"), F.concat(F.lit("Bids start at $"), money, F.lit(" for   this “kind”.\n\nBUS-43 covers the rest of it.")).alias("text"), F.array().cast("array<int>").alias("borders"))
    text = F.concat(F.when(k == 1, F.concat(F.lit("Claim "), (cents + 1).cast("string"))).when(k == 2, "So it is [1]").when(k == 3, "  ").otherwise(F.concat(F.lit("Claim "), money)), F.when(k == 5, " BUS 43").otherwise(""))
    kind = "struct<source_id:int,quote_id:int,quote:string>"
    one = lambda s, i, q: F.array(F.struct(F.lit(s).cast("int").alias("source_id"), F.lit(i).cast("int").alias("quote_id"), q.alias("quote")).cast(kind))
    quote = F.concat(F.lit("start at $"), money, F.lit(' for this "kind".'))
    support = F.when(k == 0, one(1, 1, F.lit(None))).when(k == 4, one(2, 1, F.lit(None))).when(k == 5, one(1, None, quote)).when(k == 6, one(1, 3, F.lit(None))).when(k == 7, one(1, None, F.lit("this is said nowhere in the text"))).otherwise(one(1, 1, F.lit(None)))
    return o.select(F.col("o_orderkey").alias("q_id"), F.lit(1).alias("claim"), text.alias("text"), support.alias("support")), passages


def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = am.verified(*claim_rows(spark, sf_dir))
    return out.select("q_id", "problem", F.when(F.col("problem").isNull(), F.col("line")).alias("line"), F.when(F.col("problem").isNull(), F.array_join("quotes", "|")).alias("quotes"))


def hybrid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of words and vectors: the lexical list of each question, and the nearest vectors to that with the question's number, as documents of their numbers."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"))
    asked = v.withColumnRenamed("vec_id", "q_id").join(sized(items), "q_id", "left_semi")
    near = rt.nearest(v.withColumnRenamed("vec_id", "doc_id"), asked, 30, 0.0)
    fused = rt.fuse([rt.top(corpus.chunk_lexical(spark, sf_dir), 30), near], 0, "first")
    return rt.top(fused, 10, tie="tie").select("q_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    terms = F.when(k % 3 == 0, F.concat(F.lit(" limit  of "), "c_mktsegment"))
    model = F.when(k % 3 == 1, "\n").when(k % 5 == 0, "key words")
    return table(spark, sf_dir, "customer").select("c_custkey", am.rewritten(terms, model, F.col("c_name")).alias("search"))


def hop_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ranked sections, references, sections and questions: documents in pieces of 3,000 characters, every second of which names a document by a quote from its text."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    cut = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length(text) - 1) div 3000"))).alias("k"))
    piece = F.expr("substring(text, cast(k * 3000 + 1 as int), 3000)")
    sections = saved(cut.select((F.col("doc_id") * 1000 + F.col("k")).alias("section"), "doc_id", F.lit(20).alias("start"), F.least(F.length(piece), F.lit(60)).alias("end"), piece.alias("text")))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    asked = questions.select("q_id", F.explode(F.array_distinct(tx.search_terms(F.col("question")))).alias("term")).withColumn("times", F.lit(1))
    counts = rt.frequencies(sections.withColumnRenamed("doc_id", "doc").withColumnRenamed("section", "doc_id"), s=(tx.terms(F.col("text")), asked))
    ranked = sized(rt.top(rt.bm25(counts.select("doc_id", F.col("s").alias("tf"), F.col("s_len").alias("len")), asked, 1.0).where("score > 0"), 10).select("q_id", "rank", F.col("doc_id").alias("section")))
    ranked = sections.join(ranked, "section").select("q_id", F.col("rank").cast("long").alias("rank"), "section", "doc_id", "start", "end", "text")
    named = d.select(F.col("doc_id").alias("target_doc"), F.concat_ws(" ", F.lit("about"), F.get(F.split("text", " "), F.lit(2)), F.get(F.split("text", " "), F.lit(5))).alias("label"), (F.col("doc_id") % 97).alias("slot"))
    edges = sections.where("section % 2 = 0").select(F.col("section").alias("edge"), F.col("section").alias("source"), ((F.col("doc_id") * 7 + 5) % 97).alias("slot"), F.expr("substring(text, 31, 12)").alias("quote"))
    edges = edges.join(named.groupBy("slot").agg(F.min(F.struct("target_doc", "label")).alias("x")), "slot")
    edges = edges.select("edge", "source", "x.target_doc", F.when(F.col("edge") % 5 == 0, F.col("x.target_doc") * 1000).alias("target_section"), "x.label", "quote")
    return ranked, edges, sections, questions


def passages_with_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each question: four by rank, and those that their references lead to."""
    out = am.assembled(*hop_inputs(spark, sf_dir))
    picks = F.transform("picks", lambda p: F.concat_ws(":", p["section"].cast("string"), p["a"].cast("string"), p["b"].cast("string"), F.coalesce(p["edge"].cast("string"), F.lit(""))))
    return out.select("q_id", F.array_join(picks, ",").alias("picks"), F.col("used").cast("long").alias("used"))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, every third a form, their lines as sections in a binary tree, and the addresses that some name."""
    d = records.docs(spark, sf_dir)
    i = F.col("doc_id")
    documents = d.select(i.alias("version"), "doc_id", F.concat(F.lit("Title "), i.cast("string")).alias("title"), F.when(i % 3 == 0, "form").otherwise("policy").alias("kind"), F.when(i % 4 == 0, F.concat(F.lit("P-"), i.cast("string"))).alias("policy_id"), "classification", "status")
    cut = d.select(i.alias("version"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    number = lambda k: F.col("version") * 1_000_000 + k
    sections = cut.select(number(F.col("ordinal")).alias("section"), "version", F.concat(F.lit("Line "), F.col("ordinal").cast("string")).alias("title"), F.when(F.col("ordinal") == 0, "body").otherwise("text").alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("ordinal") > 0, number(F.expr("(ordinal - 1) div 2"))).alias("parent"), "text")
    outside = d.where("doc_id % 5 < 2").select(i.alias("version"), F.explode(F.array(F.lit("FAR 1.1"), F.lit("FAR 1.1"), F.lit("https://example.org"))).alias("reference")).withColumn("uri", F.when(F.col("reference").startswith("http"), F.col("reference")))
    return documents, sections, outside


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and containing relations of the documents' graph, by kind."""
    documents, sections, outside = graph_tables(spark, sf_dir)
    own = gr.nodes(documents, sections, outside).select("kind", F.col("node").alias("id"), F.coalesce(F.map_values("properties")[0], F.lit("")).alias("property"))
    links = gr.containing(documents, sections).select(F.col("relation").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), "quote")
    of = lambda t, c: t.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(c).alias("most"))
    return of(own, "property").unionByName(of(links, "quote"))


def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found by their text alone: equal texts give the last one's id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ct.by_text(d, d)


def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of an enrichment store met with the texts of their SHA-1: pairs, texts and questions without a text, by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(F.col("text").cast("binary")).alias("key"))
    lost = F.when(F.col("doc_id") % 10 == 0, F.sha1(F.col("key").cast("binary"))).otherwise(F.col("key"))
    store = d.where("doc_id % 2 = 0").select(lost.alias("key"), F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda i: F.concat_ws(" ", F.lit("question"), i.cast("string"))).alias("questions"))
    out = ct.paired(store, d).join(d.select("doc_id", "lang"), "doc_id", "left")
    return out.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("questions"), F.count_distinct("key").alias("texts"), F.min("doc_id").alias("first"))


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines by key with their parent line, as a scope sees them."""
    k = F.col("section")
    rows = records.docs(spark, sf_dir).select("doc_id", "classification", "status", F.posexplode(F.split("text", "\n")).alias("section", "text")).withColumn("parent", F.when(k > 0, F.expr("cast((section - 1) div 2 as int)")))
    asked = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("section"))
    out = ct.looked_up(rows, asked, vs.permitted(["public", "internal"], True, False))
    return out.select("doc_id", k.cast("long").alias("k"), F.length("text").cast("long").alias("chars"), F.length("parent_text").cast("long").alias("parent_chars"))


def manifest_equalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest, entries of which name two files, against the files at hand."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    own = F.sha2(F.col("s_name").cast("binary"), 256)
    files = s.where(key % 3 != 0).select(F.concat(F.lit("My__File "), key.cast("string"), F.lit(".PDF")).alias("file"), own.alias("sha"))
    files = files.unionByName(s.where(key % 4 == 0).select(F.concat(F.lit("annex_"), key.cast("string"), F.lit(".docx")).alias("file"), own.alias("sha")))
    names = F.array(F.concat(F.lit("my_file_"), key.cast("string"), F.lit(".pdf")), F.concat(F.lit("Annex "), key.cast("string"), F.lit(".DOCX")))
    listed = s.where(key % 2 == 0).select(F.concat(F.lit("doc-"), key.cast("string")).alias("id"), names.alias("names"), F.concat(F.lit("File "), key.cast("string")).alias("title"), F.lit("review").alias("status"))
    out = ct.equalized(listed, files)
    return out.select("id", F.array_join("names", "; ").alias("names"), "title", "status", "sha")


def types_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sources with their languages in order and the number of documents."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"))


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows for a model of 128 tokens with two special ones; none is over the limit."""
    sized_ = table(spark, sf_dir, "documents").select("doc_id", corpus.word_count(F.col("text")).alias("n"))
    return am.model_windows(sized_, 128, 2).groupBy("doc_id").agg(F.count("*").alias("windows"), F.max("tokens").cast("long").alias("most"), F.count_if(F.col("tokens") > 128).alias("over"))


def reviewed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pinned sources can be cited: active, public, of the reviewed hash, and with the quote in their text."""
    d = records.docs(spark, sf_dir)
    pinned = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(ct.sha(F.col("text")))
    quote = F.when(F.col("doc_id") % 3 == 0, "not in any text").otherwise(F.substring("text", 3, 20))
    return d.groupBy(ct.citable(pinned, quote).alias("state")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def label_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against decided form requirements of requests; null counts as a value."""
    got = records_decided(spark, sf_dir)
    expected = F.when(F.col("request_id") % 17 == 0, None).otherwise(F.col("value") >= 100_000)
    return got.where(~expected.eqNullSafe(F.col("form_required"))).select("request_id", expected.alias("expected"), "form_required")


def records_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("request_id", "value", "form_required")


def quoted_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's price in thousands stands in a quote, written in one of five ways, two of them wrong."""
    v = F.floor(F.col("o_totalprice") / 1000) * 1000.0
    k = F.col("o_orderkey") % 5
    whole = v.cast("long").cast("string")
    quote = F.when(k == 0, F.concat(F.lit("at $"), F.format_number(v, 0))).when(k == 1, F.concat(F.lit("of "), whole)).when(k == 2, F.concat(F.lit("$"), (v / 1000).cast("long").cast("string"), F.lit("K"))).when(k == 3, F.concat(F.lit("$"), F.format_number(v + 1000, 0), F.lit("."))).otherwise("none")
    return table(spark, sf_dir, "orders").where("o_totalprice >= 1000").groupBy(k.alias("way"), ev.stands(v, quote).alias("stands")).agg(F.count("*").alias("n"))


def cart_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cart for each order a cent below, at, or a cent above its funding's boundary, with what it should give, and whether it does."""
    k, zero = F.col("o_orderkey"), F.lit("0").cast("decimal(14,2)")
    funding = pick("o_orderkey", ("non_federal", "federal_contract", "federal_grant", "unknown", "mixed"))
    limit = F.element_at(F.create_map(*(F.lit(x) for p in (("non_federal", rules.FORM_OTHER), ("federal_contract", rules.FORM_CONTRACT), ("federal_grant", rules.FORM_GRANT)) for x in p)), F.col("funding"))
    step = F.expr("o_custkey % 3 - 1")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", funding.alias("funding")).withColumn("limit", limit)
    amount = (F.coalesce("limit", F.lit(100)).cast("decimal(14,2)") + step.cast("decimal(14,2)") / 100).cast("decimal(14,2)")
    carts = rows.select(k, "funding", F.when(F.col("limit").isNotNull(), step >= 0).alias("expected"), amount.alias("subtotal"), zero.alias("tax"), zero.alias("shipping"), zero.alias("handling"), F.lit(1).alias("suppliers"), F.lit(True).alias("reviewed"), F.lit(True).alias("single"))
    out = rules.cart_guide(carts)
    return out.groupBy("funding", F.col("subtotal").cast("string").alias("amount"), "status").agg(F.count("*").alias("n"), F.bool_and(F.col("required").eqNullSafe(F.col("expected"))).alias("passed"))


def additional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat an earlier one's text."""
    return ct.additional_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with entries made from suppliers."""
    k = F.col("s_suppkey")
    sha = F.sha2(F.col("s_name").cast("binary"), 256)
    rows = table(spark, sf_dir, "supplier").select(
        F.when(k % 11 == 3, "No Slug").otherwise(F.concat(F.lit("entry-"), k.cast("string"))).alias("id"), F.when(k % 7 == 2, F.array(F.lit("abc"))).when(k % 7 == 3, F.array(sha)).otherwise(F.array(F.sha2(F.lit("old").cast("binary"), 256))).alias("archived"),
        F.when(k % 2 == 0, "active").otherwise("review").alias("status"), F.when(k % 5 != 0, "reviewer").alias("reviewer"), F.when(k % 13 == 4, "2024-02-31").otherwise("2024-05-01T10:00:00Z").alias("reviewed_at"), sha.alias("sha"),
    )
    return rows.groupBy(ct.entry_problem().alias("problem")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files met with a table of some of them by normalised name."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    pages = p.select("p_partkey", F.concat(F.lit("Über "), k, F.when(F.col("p_partkey") % 3 == 0, "-A.PDF").when(F.col("p_partkey") % 3 == 1, "_a.docx").otherwise("")).alias("source"))
    known = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("über_"), k, F.when(F.col("p_partkey") % 3 == 0, " a.pdf").when(F.col("p_partkey") % 3 == 1, "A.Docx").otherwise("")).alias("file"), F.col("p_name").alias("policy_name"), F.col("p_brand").alias("doc_type"))
    return ct.tagged(pages, known)


def grade_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of each order were graded how, by their discount."""
    grade = F.when(F.col("l_discount") < 0.03, "correct").when(F.col("l_discount") < 0.07, "partial").otherwise("wrong")
    out = ev.positions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("place"), grade.alias("grade")))
    return out.select("run", "grade", "n", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def difficulty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each difficulty, by their number of words, in one row."""
    n = corpus.word_count(F.col("text"))
    return table(spark, sf_dir, "benchmark").agg(F.count_if(n < 20).alias("simple"), F.count_if((n >= 20) & (n < 40)).alias("scenario"), F.count_if(n >= 40).alias("edge_case"), F.count("*").alias("total"))


def grounding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over answers: errors and refusals aren't evaluated."""
    return ev.grounding_summary(ev.grounding(records.answers(spark, sf_dir)), F.col("id") % 13 == 0, F.col("id") % 11 == 0)


def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 questions by number."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(25).select("item_id", F.length("text").cast("long").alias("chars"))


def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the pages of its lines as one range, the first ship date and, where lines have one, the first date of a discounted line by order."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber").alias("place"), F.col("l_linenumber").alias("page"), day.alias("effective"), F.when(F.col("l_discount") >= 0.09, day).alias("revision"))
    return ct.flat_metadata(rows, "l_partkey")


ITEM = '<div class="document__cell__item" id="LineItemSixPack{k}"><span class="ProductDescription">{d}</span><input name="Req_ProductHdrQuantity:{k}" value="{q}"><span id="UnitPriceValueBlock:{k}">${p} USD</span></div>'


def cart_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, quantities, prices, taxes and charges read from carts' pages; a missing charge is null and no 0."""
    li = table(spark, sf_dir, "lineitem")
    row = F.lit(ITEM)
    for mark, c in (("{k}", F.col("l_linenumber").cast("string")), ("{d}", F.concat(F.lit(" part  "), F.col("l_partkey").cast("string"))), ("{q}", F.col("l_quantity").cast("int").cast("string")), ("{p}", F.format_number("l_extendedprice", 2))):
        row = F.replace(row, F.lit(mark), c)
    k = F.col("l_orderkey")
    totals = F.concat(F.lit("<tr><td>Tax1</td><td>$1.25</td></tr>"), F.when(k % 2 == 0, "<tr><td>Tax2</td><td>2.50 USD</td></tr>").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("<tr><td>Shipping</td><td>$1,0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".00</td></tr>"))).otherwise(""))
    html = li.groupBy("l_orderkey").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("h")))), lambda x: x["h"]), ""), F.lit("<table>"), totals, F.lit("</table>")).alias("html"))
    return rules.read_cart(html, "html").select("l_orderkey", F.size("items").cast("long").alias("items"), F.get("items", F.lit(0))["description"].alias("description"), F.aggregate("items", F.lit(0).cast("decimal(24,2)"), lambda s, x: (s + x["unit_price"]).cast("decimal(24,2)")).cast("decimal(14,2)").alias("prices"), F.aggregate("items", F.lit(0).cast("decimal(24,4)"), lambda s, x: (s + x["quantity"]).cast("decimal(24,4)")).cast("long").alias("quantity"), "tax", "shipping", "handling")


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geographic graph as one JSON object a node, with its targets in order."""
    n = table(spark, sf_dir, "nation")
    targets = F.array_sort(F.collect_list(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))))
    rows = n.groupBy("n_regionkey").agg(targets.alias("targets"))
    return rows.select(F.to_json(F.struct(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("id"), "targets")).alias("value"))


def sql() -> dict[str, str]:
    s = corpus.sql()
    with_a = s["bm25_a_topk"].split(" SELECT q_id, doc_id, round(score, 6)")[0]
    top = lambda src, k, tie="doc_id": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, {tie}) AS rank FROM {src}) WHERE rank <= {k}"
    l = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)"  # noqa: E741
    body = l + """, b AS (SELECT * FROM l WHERE k % 7 <> 6 AND k % 11 <> 10), c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM b),
      p AS (SELECT doc_id, k, CAST(chars + 2 * sum((chars > 0)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS s, length(text) AS n FROM c)"""
    d = records.sql()["scope_filter"].split("WITH ")[1].split(" SELECT 'public'")[0]
    ans = records.sql()["answer_grounding"]
    money = "format('{:,d}', CAST(floor(o_totalprice) AS BIGINT))"
    return {
        "body_positions": f'WITH {body} SELECT doc_id, k AS ordinal, s AS start, s + n AS "end" FROM p',
        "block_spans": f'WITH {body}, e AS (SELECT doc_id, max(s + n) AS n FROM p GROUP BY 1), x AS (SELECT doc_id, n, unnest(range((n - 1) // 300 + 1)) AS section FROM e WHERE n > 0), y AS (SELECT doc_id, section, section * 300 AS a, least(section * 300 + 300, n) AS z FROM x) SELECT doc_id, section, k AS block, greatest(a, s) - a AS start, least(z, s + p.n) - a AS "end", greatest(a, s) - s AS source_start, least(z, s + p.n) - s AS source_end FROM y JOIN p USING (doc_id) WHERE s + p.n > a AND s < z',
        "quote_spans": f"WITH {l}, p AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY k) - length(text) - 2 AS place, regexp_replace(text, '^\\s+', '') AS r FROM l), q AS (SELECT doc_id, k, place + length(text) - length(r) AS start, regexp_replace(r, '\\s+$', '') AS quote FROM p WHERE regexp_matches(text, '\\S')) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS quote_id, CAST(start AS BIGINT) AS start, CAST(start + length(quote) AS BIGINT) AS \"end\", md5(quote) AS digest FROM q",
        "verified_claims": f"SELECT o_orderkey AS q_id, CASE o_orderkey % 8 WHEN 1 THEN 'number without evidence' WHEN 2 THEN 'own citation' WHEN 3 THEN 'blank' WHEN 4 THEN 'unknown source' WHEN 6 THEN 'unknown part' WHEN 7 THEN 'absent quote' END AS problem, CASE o_orderkey % 8 WHEN 0 THEN 'Claim ' || {money} || ' [1]' WHEN 5 THEN 'Claim ' || {money} || ' BUS 43 [1]' END AS line, CASE o_orderkey % 8 WHEN 0 THEN 'Bids start at $' || {money} || ' for   this “kind”.' WHEN 5 THEN 'start at $' || {money} || ' for   this “kind”.' END AS quotes FROM orders",
        "hybrid_dense": f"{with_a}, v AS (SELECT q.vec_id AS q_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id), u AS (SELECT q_id, doc_id, rank, 0 AS li FROM ({top('sa', 30)}) UNION ALL SELECT q_id, doc_id, rank, 1 AS li FROM ({top('(SELECT * FROM v WHERE score >= 0)', 30)})), f AS (SELECT q_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score, min(li * 1000000 + rank) AS tie FROM u GROUP BY 1, 2) SELECT q_id, doc_id, round(score, 9) AS score, rank FROM ({top('f', 10, 'tie')})",
        "rewrites": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'limit of ' || regexp_replace(c_mktsegment, '\\s+', ' ', 'g') WHEN c_custkey % 3 <> 1 AND c_custkey % 5 = 0 THEN 'key words' ELSE c_name END AS search FROM customer",
        "graph_nodes": f"""WITH {d}, s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
          n AS (SELECT 'document' AS kind, 'document:' || doc_id AS id, doc_id::VARCHAR AS p FROM d UNION ALL SELECT 'form', 'form:' || doc_id, doc_id::VARCHAR FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT 'section', 'section:' || (doc_id * 1000000 + k), CASE WHEN k = 0 THEN 'body' ELSE 'text' END FROM s
            UNION ALL SELECT 'reference', 'reference:' || substr(sha256(doc_id || ':' || r), 1, 20), 'false' FROM d, (VALUES ('FAR 1.1'), ('https://example.org')) AS v(r) WHERE doc_id % 5 < 2
            UNION ALL SELECT 'contains', CASE WHEN k = 0 THEN 'document:' || doc_id ELSE 'section:' || (doc_id * 1000000 + (k - 1) // 2) END || '>section:' || (doc_id * 1000000 + k), substr(text, 1, 160) FROM s UNION ALL SELECT 'has_source', 'form:' || doc_id || '>document:' || doc_id, substr(text, 1, 160) FROM s WHERE k = 0 AND doc_id % 3 = 0)
          SELECT kind, count(*) AS n, min(id) AS first, max(id) AS last, max(p) AS most FROM n GROUP BY 1""",
        "text_join": "SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS found FROM documents",
        "pair_join": "WITH d AS (SELECT doc_id, lang, sha1(text) AS key FROM documents), st AS (SELECT CASE WHEN doc_id % 10 = 0 THEN sha1(key) ELSE key END AS key, max(doc_id % 3 + 1) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY 1), t AS (SELECT key, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM d GROUP BY 1) SELECT coalesce(lang, 'none') AS lang, CAST(sum(n) AS BIGINT) AS questions, count(*) AS texts, min(doc_id) AS first FROM st LEFT JOIN t USING (key) GROUP BY 1",
        "section_lookup": f"WITH {d}, s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM d WHERE classification IN ('public', 'internal') AND status IN ('active', 'review')) SELECT a.doc_id, a.k, length(a.line) AS chars, length(p.line) AS parent_chars FROM s a JOIN labels y ON y.doc_id = a.doc_id AND y.doc_id % 5 = a.k LEFT JOIN s p ON p.doc_id = a.doc_id AND a.k > 0 AND p.k = (a.k - 1) // 2",
        "manifest_equalized": """WITH s AS (SELECT s_suppkey AS k, sha256(s_name) AS sha, s_suppkey % 3 <> 0 AS f, s_suppkey % 4 = 0 AS x FROM supplier)
          SELECT 'doc-' || k AS id, CASE WHEN f AND x THEN 'my_file_' || k || '.pdf' WHEN x THEN 'Annex ' || k || '.DOCX; my_file_' || k || '.pdf' ELSE 'my_file_' || k || '.pdf; Annex ' || k || '.DOCX' END AS names, 'File ' || k AS title, CASE WHEN f OR x THEN 'active' ELSE 'review' END AS status, CASE WHEN f OR x THEN sha END AS sha FROM s WHERE k % 2 = 0
          UNION ALL SELECT 'annex-' || k, 'Annex ' || k || '.DOCX', 'annex ' || k, 'active', sha FROM s WHERE f AND x UNION ALL SELECT 'my-file-' || k, 'My__File ' || k || '.PDF', 'My  File ' || k, 'active', sha FROM s WHERE f AND k % 2 = 1""",
        "types_and_files": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY 1",
        "model_windows": r"WITH c AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(CASE WHEN n <= 118 THEN 1 ELSE 1 + CAST(ceil((n - 118) / 78) AS BIGINT) END)) AS k FROM c WHERE n > 0) SELECT doc_id, count(*) AS windows, max(least(k * 78 + 118, n) - k * 78 + 2) AS most, 0::BIGINT AS over FROM w GROUP BY 1",
        "reviewed_sources": f"WITH {d} SELECT CASE WHEN classification IS NULL THEN 'not public' WHEN status <> 'active' THEN 'not active' WHEN classification <> 'public' THEN 'not public' WHEN doc_id % 4 = 0 THEN 'changed' WHEN doc_id % 3 = 0 THEN 'quote changed' ELSE 'fine' END AS state, count(*) AS n, min(doc_id) AS first FROM d GROUP BY 1",
        "label_mismatches": REQ + ", a AS (SELECT request_id, CASE WHEN request_id % 17 <> 0 THEN value >= 100000 END AS expected, form_required FROM t) SELECT * FROM a WHERE expected IS DISTINCT FROM form_required",
        "quoted_constants": "SELECT o_orderkey % 5 AS way, o_orderkey % 5 < 3 AS stands, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1, 2",
        "cart_suite": f"WITH a AS (SELECT {choose(('non_federal', 'federal_contract', 'federal_grant', 'unknown', 'mixed'))} AS funding, o_custkey % 3 - 1 AS step FROM orders) SELECT funding, CAST(CAST(CASE funding WHEN 'non_federal' THEN 100000 WHEN 'federal_contract' THEN 15000 WHEN 'federal_grant' THEN 50000 ELSE 100 END + step / 100 AS DECIMAL(14,2)) AS VARCHAR) AS amount, CASE WHEN funding IN ('unknown', 'mixed') THEN 'needs_details' ELSE 'checked' END AS status, count(*) AS n, TRUE AS passed FROM a GROUP BY 1, 2, 3",
        "additional_files": "WITH f AS (SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) SELECT 'document:' || first || ':' || sha AS version_id, doc_id, first FROM f WHERE doc_id <> first",
        "manifest_entries": "WITH k AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 3 THEN 'No Slug' ELSE 'entry-' || s_suppkey END AS id FROM supplier) SELECT CASE WHEN k % 11 = 3 THEN 'no slug' WHEN k % 7 = 2 THEN 'archived version without a hash' WHEN k % 7 = 3 THEN 'current version is archived' WHEN k % 2 = 0 AND k % 5 = 0 THEN 'active without review' WHEN k % 2 = 0 AND k % 13 = 4 THEN 'review is no date' END AS problem, count(*) AS n, min(id) AS first FROM k GROUP BY 1",
        "tagged_files": "WITH s AS (SELECT *, 'Über ' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '-A.PDF' WHEN 1 THEN '_a.docx' ELSE '' END AS source FROM part) SELECT p_partkey, source, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE source END AS policy_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'General Policy' END AS doc_type, CASE p_partkey % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' ELSE 'UNKNOWN' END AS file_format FROM s",
        "grade_positions": "SELECT l_orderkey AS run, CASE WHEN l_discount < 0.03 THEN 'correct' WHEN l_discount < 0.07 THEN 'partial' ELSE 'wrong' END AS grade, count(*) AS n, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS positions FROM lineitem GROUP BY 1, 2",
        "difficulty_counts": r"WITH c AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM benchmark) SELECT count(*) FILTER (n < 20) AS simple, count(*) FILTER (n >= 20 AND n < 40) AS scenario, count(*) FILTER (n >= 40) AS edge_case, count(*) AS total FROM c",
        "grounding_summary": f"WITH g AS ({ans}), h AS (SELECT *, id % 13 <> 0 AND id % 11 <> 0 AS done FROM g) SELECT count(*) AS total, count(*) FILTER (id % 13 = 0) AS execution_errors, count(*) FILTER (id % 13 <> 0 AND id % 11 = 0) AS refusals, count(*) FILTER (done) AS evaluated, count(*) FILTER (done AND review) AS flagged, count(*) FILTER (done AND invalid_refs <> '') AS invalid_citations, count(*) FILTER (done AND unmatched <> '') AS unmatched_dollar_amounts, count(*) FILTER (done AND question_only <> '') AS question_amounts_not_in_evidence FROM h",
        "first_questions": "SELECT item_id, length(text) AS chars FROM benchmark ORDER BY item_id LIMIT 25",
        "flat_metadata": "WITH a AS (SELECT l_partkey, min(l_linenumber) AS a, max(l_linenumber) AS z, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'))) AS effective_date, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'))) FILTER (l_discount >= 0.09) AS revision_date, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END AS page, effective_date, revision_date, n FROM a",
        "cart_page": "SELECT l_orderkey, count(*) AS items, 'part ' || min({'a': l_linenumber, 'b': l_partkey}).b AS description, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS prices, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 3.75 ELSE 1.25 END AS DECIMAL(14,2)) AS tax, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 1000 + l_orderkey % 100 END AS DECIMAL(14,2)) AS shipping, CAST(NULL AS DECIMAL(14,2)) AS handling FROM lineitem GROUP BY 1",
        "graph_json": "SELECT '{\"id\":\"region:' || n_regionkey || '\",\"targets\":[' || string_agg('\"nation:' || n_nationkey || '\"', ',' ORDER BY 'nation:' || n_nationkey) || ']}' AS value FROM nation GROUP BY n_regionkey",
    }


NAMES = (
    "body_positions block_spans quote_spans verified_claims passages_with_hop hybrid_dense rewrites graph_nodes text_join pair_join section_lookup manifest_equalized types_and_files model_windows reviewed_sources "
    "label_mismatches quoted_constants cart_suite additional_files manifest_entries tagged_files grade_positions difficulty_counts grounding_summary first_questions flat_metadata cart_page graph_json"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
