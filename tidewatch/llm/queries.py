"""The registered queries of the corpus operators, each over its whole table."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import durable, fresh_path
from tidewatch.llm import blocknames, collocations, decontam, langid, mixing, neardup, quality, substring, tokens, topk, toxicity, variants, warc
from tidewatch.llm.common import in_fold, ship, table

# Parameters of the production runs.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    # The records without payloads are thin; written, so that the archives are parsed once.
    return warc.digest_report(warc.assemble(durable(warc.read(spark, path, payloads=False), "records")))


def token_lists(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens.write(table(spark, folder, "documents"), path, tokenizer_path())
    return tokens.digests(tokens.read(spark, path))


def crf_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), in_fold(F.col("doc_id"), 4, 2)
    return langid.predicted(docs, langid.trained(docs, ~held_out)).withColumn("held_out", held_out)


def compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), in_fold(F.col("doc_id"), 3, 1)
    scored = quality.score(docs, quality.trained(docs, table(spark, folder, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), in_fold(F.col("doc_id"), 3, 1)
    return toxicity.graded(docs, toxicity.trained(docs, table(spark, folder, "labels"), ~held_out)).withColumn("held_out", held_out)


def circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), neardup.Spec(width=3, percent=85, bands=25, rows=5))


def automaton_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def seeded_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return blocknames.exact_copies(table(spark, folder, "documents"))


def bruijn_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), least=10, absorb_percent=50, most=2_000)


def permuterm_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"), slips=31)


Query = Callable[[SparkSession, str], DataFrame]


def _shipping(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


_QUERIES: dict[str, Query] = {
    "op1_crf_language": crf_language,
    "op2_compression_quality": compression_quality,
    "op3_warc_transactions": warc_transactions,
    "op4_token_lists": token_lists,
    "op5_maxscore_topk": maxscore_topk,
    "op6_pareto_mix": pareto_mix,
    "op7_ordinal_toxicity": ordinal_toxicity,
    "op8_circulant_minhash": circulant_minhash,
    "op9_automaton_repeats": automaton_repeats,
    "op10_seeded_overlaps": seeded_overlaps,
    "op11_block_naming": block_naming,
    "op12_bruijn_collocations": bruijn_collocations,
    "op13_permuterm_variants": permuterm_variants,
}
QUERIES = {name: _shipping(query) for name, query in _QUERIES.items()}
