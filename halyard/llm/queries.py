"""One query per corpus operator over its whole table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import (alignment, chat, exact_dedup, html_text, mixing, near_dup, packing, pii,
                         prefix_trie, quality, sharding, simhash, warc)

# The driver's tables have no secret of their own; a real run passes its key.
PSEUDONYM_KEY = "halyard-demo-key"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records derived from ``pages``: a full response each, a later
    revisit with validators that fit, fit weakly, are dates only or are stale,
    and for every fifth page a revisit that comes first."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    k, etag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    base = pages.select("page_id", "url", etag.alias("tag"), F.concat(F.lit("day "), (k % 97).cast("string")).alias("day"),
                        F.sha1("html").alias("sum"), F.length("html").cast("bigint").alias("n"))
    none = F.lit(None).cast("string")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    full = base.select((k * 4).alias("record_id"), "url", (k * 10).alias("ts"), F.lit("response").alias("type"),
                       F.col("tag").alias("etag"), F.col("day").alias("last_modified"), F.col("sum").alias("digest"),
                       F.col("n").alias("n_chars"),
                       pair("content-type", "text/html", "content-length", F.col("n").cast("string"), "etag", F.col("tag"),
                            "cache-control", "max-age=60").alias("headers"))
    sent = (F.when(k % 4 == 0, F.col("tag")).when(k % 4 == 1, F.concat(F.lit("W/"), F.col("tag")))
            .when(k % 4 == 3, F.lit('"stale"')))
    again = base.select((k * 4 + 1).alias("record_id"), F.concat("url", F.when(F.col("url").contains("#"), "").otherwise("#again")).alias("url"),
                        (k * 10 + 5).alias("ts"), F.lit("revisit").alias("type"), sent.alias("etag"),
                        F.when(k % 4 == 2, F.col("day")).alias("last_modified"), none.alias("digest"),
                        F.lit(None).cast("bigint").alias("n_chars"),
                        pair("content-length", "0", "cache-control", F.concat(F.lit("max-age="), (k % 7).cast("string")),
                             "x-seen", k.cast("string")).alias("headers"))
    early = base.filter(k % 5 == 0).select(
        (k * 4 + 2).alias("record_id"), "url", (k * 10 - 5).alias("ts"), F.lit("revisit").alias("type"), F.col("tag").alias("etag"),
        none.alias("last_modified"), none.alias("digest"), F.lit(None).cast("bigint").alias("n_chars"),
        pair("x-seen", "early").alias("headers"))
    return full.unionByName(again).unionByName(early)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc_records(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(pairs, ";"))


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for conv_id, formatted, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["spans"]):
            turns = chat.read_turns(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(chat.unescape(formatted[s["text_start"]:s["text_end"]]) for s in spans if s["role"] == "assistant")
            out.append((conv_id, len(turns), sha256(said.encode()).hexdigest(), len(loss),
                        sha256(loss.encode()).hexdigest(), len(formatted)))
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))


# The conversation whose texts hold control strings (fixed by the contract).
HARD_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)],
                                 "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(own.unionByName(hard)).select("conv_id", "formatted", "spans")
    return made.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), measures=True)
    v = F.col("verdict")
    failed = (v["n_words"] < 50) | (100 * v["n_repeat_words"] > 50 * v["n_words"])
    return judged.select("doc_id", *[v[m].alias(m) for m in quality.MEASURES], failed.alias("base_failed"),
                         (~failed & v["kept"]).alias("kept"))


def op9_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"), width=4, reach=4)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                         tokenizer_path("piece_bpe_32k.model"), b_size=32_000)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pareto_mix, op2_warc_revisits, op3_chat_format, op4_exact_dedup, op5_minhash_tensored,
                            op6_histogram_shards, op7_feistel_pseudonyms, op8_quality_cascade, op9_html_suffix_array,
                            op10_ffd_packing, op11_prefix_trie, op12_simhash_vptree, op13_token_alignment,
                            pipeline)}
