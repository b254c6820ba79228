"""The registered queries over the driver's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, hashed_embedding
from ..operators import relational as R
from ..operators import search as S
from ..operators.ask import ask
from ..operators.chunk import chunks_of_texts, sentences_of_texts
from ..operators.ingest import read_files
from ..operators.terms import frequencies, term_counts, tokens_of
from ..sources import native as N
from ..sources.tables import spread, written
from ..streaming.files import windowed_activity
from .oracle import NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(of: Callable) -> Callable:
    QUERIES[of.__name__] = of
    return of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt to all cores."""
    return spread(table(spark, d, name))


def found(spark: SparkSession, d: str, **lists: int) -> DataFrame:
    """Each benchmark text as a question to all documents."""
    return S.candidates(table(spark, d, "benchmark"), "item_id", F.col("text"), texts(spark, d), "doc_id", F.col("text"), lists)


@query
def bm25_topk(spark, d):
    """Each benchmark text as a question: the top documents by BM25."""
    top = S.TUNING.top
    return S.ranked(found(spark, d, bm25=top).select("item_id", "doc_id", "bm25"), "item_id", F.desc("bm25"), F.col("doc_id"), at_most=top)


@query
def bm25_coverage(spark, d):
    top = S.TUNING.top
    return S.ranked(found(spark, d, coverage=top).select("item_id", "doc_id", "coverage"), "item_id", F.desc("coverage"), F.col("doc_id"), at_most=top)


def pairs(spark, d):
    return found(spark, d, vector_score=S.TUNING.depth, bm25=S.TUNING.depth)


@query
def rrf_fusion(spark, d):
    return S.both_lists(pairs(spark, d), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query
def hybrid_rank(spark, d):
    return S.hybrid(pairs(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"), "vector_score", "coverage")


@query
def references_penalty(spark, d):
    """The ranking of hybrid_rank where every tenth document stands under a heading of references, which questions on citations ask for."""
    heading = F.when(F.col("doc_id") % 10 == 0, "Paper › References").otherwise("Paper › Results")
    asked = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, F.concat(F.col("text"), F.lit(" citations?"))).otherwise(F.col("text")).alias("question"))
    rows = pairs(spark, d).join(asked, "item_id")
    top = S.hybrid(rows, "item_id", "doc_id", heading, F.col("question"))
    return top.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def relevance_gate(spark, d):
    return S.relevant(hybrid_rank(spark, d))


@query
def tokenize_terms(spark, d):
    t = tokens_of(texts(spark, d), "doc_id", F.col("text"))
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_unique"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


def vocabulary(spark, d):
    return frequencies(term_counts(texts(spark, d), "doc_id", F.col("text")))


@query
def stem_vocab(spark, d):
    return vocabulary(spark, d).select("term", F.col("tf").alias("n"), F.col("df").alias("docs"))


@query
def token_counts(spark, d):
    text = F.col("text")
    return texts(spark, d).select("doc_id", T.word_count(text).cast("long").alias("n_words"), T.approx_token_count(text).cast("long").alias("n_approx"))


@query
def doc_frequency(spark, d):
    docs = texts(spark, d)
    df = frequencies(term_counts(docs, "doc_id", F.col("text")))
    n = docs.agg(F.count("*").alias("n"))  # one row
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query
def tf_idf_centroid(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("total"))  # one row
    return stem_vocab(spark, d).crossJoin(F.broadcast(n)).select("term", F.round(F.col("n") * F.log(1 + F.col("total") / F.col("docs")), 6).alias("weight"))


@query
def hash_bucket_embedding(spark, d):
    e = hashed_embedding(texts(spark, d), "doc_id", F.col("text"))
    return e.groupBy("bucket").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return S.dense_top_k(v, v.where("vec_id % 50 = 0"), 10)


@query
def cosine_scoped_topk(spark, d):
    v = table(spark, d, "embeddings")
    return S.dense_top_k(v, v.where("vec_id % 50 = 0"), 10, same_label=True)


@query
def nearest_per_label(spark, d):
    """The three vectors nearest to the mean of each label."""
    v = table(spark, d, "embeddings")
    means = v.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))  # one entry a dimension
    scored = v.join(mean, "label").select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))
    return S.ranked(scored, "label", F.desc("score"), F.col("vec_id"), at_most=3)


@query
def text_blocks(spark, d):
    """Blocks of documents; these hold single line breaks, which are doubled to part paragraphs."""
    return N.text_blocks(texts(spark, d), "doc_id", F.regexp_replace("text", "\n", "\n\n"))


@query
def html_headings(spark, d):
    return N.html_elements(table(spark, d, "pages"), "page_id", F.col("html"), "h1")


@query
def html_paragraphs(spark, d):
    return N.html_elements(table(spark, d, "pages"), "page_id", F.col("html"), "p")


@query
def html_list_items(spark, d):
    return N.html_elements(table(spark, d, "pages"), "page_id", F.col("html"), "li")


@query
def html_text(spark, d):
    text = N.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query
def labelled_rows(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.labelled_row(["Customer", "Segment", "Nation"], [F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")]).alias("line"))


@query
def quote_verify(spark, d):
    return S.quotes_in(table(spark, d, "benchmark"), "item_id", F.col("text"), texts(spark, d), "doc_id", F.col("text"))


@query
def quote_first_match(spark, d):
    return quote_verify(spark, d).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("matches"))


@query
def eval_hit_at_k(spark, d):
    """How many benchmark texts stand in the first, one of the first three, one of the top documents found for them."""
    hits = bm25_topk(spark, d).join(quote_verify(spark, d), ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("rank"))
    r = F.col("rank")
    return table(spark, d, "benchmark").join(hits, "item_id", "left").agg(F.count("*").alias("questions"), F.count_if(r == 1).alias("hit1"), F.count_if(r <= 3).alias("hit3"), F.count("rank").alias("hitk"))


@query
def exact_dup_docs(spark, d):
    return R.exact_duplicates(table(spark, d, "documents"), "doc_id", F.col("text"))


@query
def question_plan(spark, d):
    plan = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_plan(F.col("text")).alias("p"))
    return plan.select("conv_id", "turn", F.size("p.topic").alias("n_topic"), "p.overview", "p.asks")


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query
def review_stats(spark, d):
    return R.stats(labelled(spark, d), R.review_status(F.col("quality"), F.col("toxic")))


@query
def review_buckets(spark, d):
    return labelled(spark, d).groupBy("source", R.review_status(F.col("quality"), F.col("toxic")).alias("status")).agg(F.count("*").alias("n"))


@query
def pending_first_n(spark, d):
    """The next 25 documents without a label: a batch, as the feature asks."""
    left = R.without(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id").orderBy("doc_id").limit(25)
    return left.withColumn("turn", F.row_number().over(W.orderBy("doc_id")))


@query
def document_list_counts(spark, d):
    return R.with_child_count(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, d, "orders"), "o_custkey", "orders")


@query
def nested_set_export(spark, d):
    """One line a conversation: its turns in order."""
    turns = table(spark, d, "conversations").where("role <> 'system'")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), " | ").alias("thread"))


@query
def multi_hop_join(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    placed = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def scope_semi(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query
def scope_in(spark, d):
    return table(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5)).select("vec_id", "label")


@query
def dedup_first_occurrence(spark, d):
    first = table(spark, d, "conversations").groupBy("text").agg(F.min(F.struct("conv_id", "turn", "role")).alias("f"))  # combined before the shuffle, however often a text occurs
    return first.select("f.conv_id", "f.turn", "text")


@query
def neighbour_context(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    chars = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", chars(F.lag("text").over(w)).alias("before_chars"), chars(F.lead("text").over(w)).alias("after_chars"))


@query
def csv_export_lines(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", R.csv_line(c.c_custkey, c.c_name, c.c_mktsegment, F.floor("c_acctbal")).alias("line"))


@query
def format_relative(spark, d):
    return table(spark, d, "events").select("event_id", T.format_relative(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(NOW)).alias("said"))


def parted(spark, d):
    """Documents with their line breaks doubled, so that each line is a paragraph."""
    return texts(spark, d).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query
def sentences(spark, d):
    return sentences_of_texts(texts(spark, d), "doc_id")


@query
def chunks(spark, d):
    return chunks_of_texts(parted(spark, d), "doc_id")


@query
def chunk_pages(spark, d):
    """Passages and characters of every document."""
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.length("content")).alias("chars"))


@query
def doc_summary(spark, d):
    """Key points of every document, read as a plain text file: the ingest path from bytes to summary."""
    files = parted(spark, d).select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").cast("string").alias("filename"), F.current_timestamp().alias("modified"), F.lit("text").alias("kind"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("struct<code:int, text:string>").alias("refused"))
    read = read_files(files)
    points = F.transform("summary.key_points", lambda p: p["text"])
    return read.select(F.col("filename").cast("long").alias("doc_id"), "error", "char_count", F.size("chunks").alias("passages"), F.array_join(points, " | ").alias("key_points"), "summary.abstract")


@query
def offline_answers(spark, d):
    """Each benchmark text asked of the passages of all documents, or of the newest ones where it asks for an overview: search, gate, extract, verify."""
    passages = written(chunks(spark, d)).select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "chunk_index", "content", "heading", "page_start", "page_end")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").alias("created"))
    found = ask(asked, passages, documents)
    return found.select("question_id", "mode", "confidence", "insufficient", "answer", F.size("citations").alias("n_citations"), F.size(F.filter("citations", lambda c: c["verified"])).alias("n_verified"))


@query
def activity_windows(spark, d):
    """Events by hour and type, as the stream would count them."""
    return windowed_activity(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
