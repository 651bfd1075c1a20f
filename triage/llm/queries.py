"""The operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import (chat_tools, decontaminate, embed_join, exact_dedup, fill_middle, line_chunks, ngram_join, packing, pii, prefix_trie,
                        secrets, suffix_dedup, toxicity)
from triage.llm.common import land, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Key of the pseudonyms in the query; a user passes their own.
QUERY_KEY = "published key of the query"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, with models trained on values of the base patterns and words of the same documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.samples_from(docs))
    found = secrets.scan(docs, model)
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed(F.col("secrets")).alias("spans"), n("random"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents with pseudonyms in place of personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, QUERY_KEY).select("doc_id", "text", *[f"n_{k}" for k in pii.NAMES])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_join.link(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), k=4, percent=85).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_rows(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every document without the chunks of lines that an earlier place has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "text")


#: Tools of the calls derived from conversations.
TOOLS = [
    ("search", '{"type":"object","required":["query","limit"],"additionalProperties":false,"properties":{"query":{"type":"string",'
               '"minLength":20},"limit":{"type":"integer","minimum":1,"maximum":9},"after":{"type":"string"}}}'),
    ("translate", '{"type":"object","required":["text","to"],"properties":{"text":{"type":"string","minLength":1},'
                  '"to":{"enum":["en","de","fr"]},"after":{"type":"string"}}}'),
]


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool traffic from whole conversations: a user's turn asks a tool, the turn after it is the result.

    The third tool in turn, count, is in no catalogue; every fourth call begins a new chain, others refer to the call before; some
    arguments break their schema, as the texts happen to.
    """
    user = turns.where("role = 'user'")
    name = F.expr("case pmod(conv_id + turn, 5) when 0 then 'count' when 1 then 'translate' when 3 then 'translate' else 'search' end")
    after = F.expr("case when pmod(turn, 8) > 1 then concat('$result:c', turn - 2) end")
    text = F.coalesce("text", F.lit(""))
    arguments = F.when(name == "translate", F.to_json(F.struct(
        text.alias("text"), F.expr("element_at(array('en', 'de', 'fr', 'xx'), cast(pmod(conv_id, 4) as int) + 1)").alias("to"), after.alias("after")))
    ).otherwise(F.to_json(F.struct(text.alias("query"), F.expr("pmod(turn, 11)").alias("limit"), after.alias("after"))))
    calls = user.select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from all conversations: linked, ordered, checked and written as canonical JSON."""
    calls, results = derived_calls(table(spark, sf_dir, "conversations"))
    tools = spark.createDataFrame(TOOLS, "name string, schema string")
    return chat_tools.link_calls(calls, results, tools).withColumn("errors", F.array_join("errors", "; "))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and digests of all documents, rearranged from a store of compressed frames."""
    store = land(fill_middle.frame_store(table(spark, sf_dir, "documents").select("doc_id", "text")), "frames")
    return fill_middle.digests(fill_middle.rearrange(store)).select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun like the first of its family of twenty."""
    trie = prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))
    found = trie.nodes.join(prefix_trie.end_digests(trie.ends), "node", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing,
    "op5_embedding_join": op5_embedding_join, "op6_ngram_join": op6_ngram_join,
    "op7_suffix_dedup": op7_suffix_dedup, "op8_decontamination": op8_decontamination, "op9_line_dedup": op9_line_dedup,
    "op10_tool_calls": op10_tool_calls, "op11_fill_middle": op11_fill_middle, "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}
