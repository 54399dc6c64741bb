"""Queries of this subpackage, ``name -> (spark, sf_dir) -> DataFrame``, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, table
from .licences import licences_sql
from .phrases import collocations_sql
from .variants import variants_sql


def op1_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read_tokens, write_tokens

    folder = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), vocabulary(), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chats

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_chats(turns))


def op3_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_edits

    return compare_edits(table(spark, sf_dir, "documents"))


def op4_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets, joined

    got = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda x: x == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return got.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import remainder, score_toxicity

    got = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The tokenizer file of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op9_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    got = encode(table(spark, sf_dir, "documents"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_pcy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .rankbpe import encode_ranks

    got = encode_ranks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_planes, op2_incremental, op3_parsing, op4_grammar, op5_latent, op6_noisy_channel, op7_superminhash, op8_sentence_rules, op9_transducer, op10_debruijn, op11_trie, op12_pcy, op13_tiktoken)
}
SQL: dict[str, str] = {"op8_sentence_rules": licences_sql(), "op11_trie": variants_sql(), "op12_pcy": collocations_sql()}
