"""One query per operator, with production parameters, over the whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadlake.llm import sql
from spreadlake.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.neardup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    weights = learn(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score(docs, weights, keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from spreadlake.llm.tokencount import byte_level_pieces, count_pieces

    heads, tails = byte_level_pieces(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return count_pieces(table(spark, sf_dir, "documents"), heads, tails)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.langid import identify

    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    found = identify(docs, ~F.col("held_out"), keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.substring import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.lm import score_texts

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
    scored = score_texts(docs, crc_mod("doc_id", 5) != 1, keep=("held_out",))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from spreadlake.llm.packing import pack

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.dialogue import digests, repair

    lines, found = repair(table(spark, sf_dir, "conversations"))
    found = found.join(digests(lines), "_key", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", none)).drop("_key")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlake.llm.manifest import folded, manifest

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(table(spark, sf_dir, "documents"), tampered={"text": lower}, where=crc_mod("doc_id", 5) == 0)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.encode(F.array_join("proof", ""), "utf-8"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from spreadlake.llm.bpe import decode, encode

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    found = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_source_mixing,
        op3_embedding_near_dedup,
        op4_quality_classifier,
        op5_token_counts,
        op6_jaccard_join,
        op7_language_id,
        op8_substring_dedup,
        op9_pitman_yor_scores,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_merkle_manifest,
        op13_bpe_round_trip,
    )
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": sql.MIXING,
    "op3_embedding_near_dedup": sql.NEAR_VECTORS,
    "op6_jaccard_join": sql.JACCARD,
    "op8_substring_dedup": sql.SUBSTRING,
    "op11_conversation_repair": sql.REPAIR,
    "op12_merkle_manifest": sql.MANIFEST,
}
