"""Registered queries of the operators: each binds one operator, with production parameters, to its table."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from exprmat.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.token_ids import read_token_ids, write_token_ids

    folder = write_token_ids(table(spark, sf_dir, "documents"), tokenizer_path())
    return read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.warc import read_warc, write_warc

    index = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.decontaminate import contaminated, decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


#: Target token weights of the label classes (quality, toxic) that the mixing query and stage use.
TARGETS = {"q1t0": 0.9, "q0t0": 0.05, "q1t1": 0.04, "q0t1": 0.01}


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), label_domains(spark, sf_dir), TARGETS)


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a fetch time: a minute of 2024 that follows from the page id."""
    minute = (F.col("page_id") % 525_600) * 7919 % 525_600
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(1_704_067_200 + 60 * minute).alias("fetched_at"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list over all hosts of ``pages``: a fifth of them is blocked, removed again 60 days later and
    half of those blocked anew; parent domains of a seventh are blocked; a third has its /en pages allowed;
    and two words are blocked. Days follow from a digest of the host."""
    from exprmat.llm.url_lists import url_host

    def day(n):
        return F.timestamp_seconds(F.lit(1_704_067_200) + 86_400 * n)

    def entry(kind, pattern, action, dated):
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), dated.alias("dated"))

    x, host = F.col("x"), F.col("host")
    parent = F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1)
    hosts = (table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host")).where("host is not null").distinct()
             .withColumn("x", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")))
    made = hosts.select(F.explode(F.filter(F.array(
        F.when(x % 5 == 0, entry("host", host, "block", day(x % 200))),
        F.when(x % 5 == 0, entry("host", host, "remove", day(x % 200 + 60))),
        F.when(x % 10 == 0, entry("host", host, "block", day(x % 200 + 120))),
        F.when((x % 7 == 0) & (parent != ""), entry("domain", parent, "block", day(x % 300))),
        F.when(x % 3 == 0, entry("path", F.concat(host, F.lit("/en")), "allow", day(F.lit(100)))),
    ), lambda e: e.isNotNull())).alias("e")).select("e.*").distinct()
    words = spark.range(2).select(F.lit("word").alias("kind"), F.when(F.col("id") == 0, "cheap").otherwise("pills").alias("pattern"),
                                  F.lit("block").alias("action"), day(F.lit(30)).alias("dated"))
    return made.union(words)


@query
def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.url_lists import filter_urls

    return filter_urls(page_captures(spark, sf_dir), page_lists(spark, sf_dir))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.html_template import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from exprmat.llm.token_align import align

    out = align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of ``conv_id:turn``: of twenty rows one each is dropped,
    emptied, stripped of its sentence ends, repeated, and given to the user. A null is one blank."""
    def text_of(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                                (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("fate"))
    fate = F.col("fate")
    return rows.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("again")).drop("again")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.conversation import conversation_digests, repair

    told = table(spark, sf_dir, "conversations")
    fixed = repair(damaged(told))
    ids = told.select("conv_id").distinct()
    out = ids.join(fixed.conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    digests = conversation_digests(fixed.rows)
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left")

    def number(name):
        return F.coalesce(name, F.lit(0).cast("long")).alias(name)

    return out.select("conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exprmat.llm.line_dedup import dedup, empty_state, insert

    docs = table(spark, sf_dir, "documents")
    out = dedup(insert(empty_state(spark), docs), docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
