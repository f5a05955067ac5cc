"""The registered queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter as urls
from .common import held_out, small_pieces, table, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import dictionaries, identify, training_rows

    docs = table(spark, sf_dir, "documents")
    learned = dictionaries(docs.where(training_rows(docs)))
    seen = identify(docs, learned, keep=("doc_id",))
    return seen.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("pii_base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)), F.sha2(pii.spelled(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("pii_spans")).alias("spans")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_classes

    return ngram_classes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    # Scores are written here, as how texts are read is a setting of the session when the work is done.
    with small_pieces(spark):
        scored = written(toxicity(docs, model), "scores")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "clauses")


QUERIES = {f.__name__: f for f in (op1_bpe_encode_decode, op2_secret_scan, op3_language_id, op4_url_filter, op5_html_extraction, op6_media_columns, op7_pii, op8_decontamination, op9_ngram_jaccard_join, op10_toxicity)}

ORACLES = {"op4_url_filter": urls.oracle_sql()}
