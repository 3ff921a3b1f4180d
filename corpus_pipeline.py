"""A corpus run of five stages, each over all documents that the one before kept.

Documents that the quality classifier rejects go; of each group of near-duplicates one document
stays; documents that overlap with the benchmark go; sources are mixed to target weights, which
repeats some documents; what is left is written as token ids. ``run`` writes each stage's result
as a table and reads it again for the next.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import durable, fresh_path
from tidewatch.llm import decontam, mixing, neardup, quality, tokens
from tidewatch.llm.common import in_fold, packed, ship, table, unpacked
from tidewatch.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by a model from the labels (those held out by op2 stay unused here too).

    A row is scored on its whole text alone, so repeated rows go or stay together; null and empty
    texts get what the model gives to no difference. Labels that are null, clash or lack a document
    are not learned from; without labels every score is 0.5 and every row stays.
    """
    ship(spark)
    model = quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 3, 1))
    texts = packed(docs)
    return unpacked(quality.score(texts, model, tuple(texts.columns), "quality").where("quality >= 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of their five-word shingles.

    The first by doc_id (nulls last), then text stays; of equal rows one. Null texts and texts
    without words are linked with nothing and stay, a text of fewer words is one shingle; long texts
    are compared whole.
    """
    ship(spark)
    return neardup.deduplicated(docs, neardup.Spec())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no window of a benchmark item.

    Repeated rows go or stay together; null and empty texts stay; long texts are looked at whole;
    an empty benchmark lets every row stay.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own; null and empty texts have no words and come as often as
    their whole copies and their rank give; ties of rank go by row, so equal rows are drawn apart.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens, read back from the files written.

    In order of doc_id (nulls first), then text; every row is kept, a null or empty text as the end
    id alone. Other columns are not written.
    """
    ship(spark)
    path = fresh_path(spark, "tokens")
    tokens.write(docs, path, tokenizer_path())
    return tokens.read(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

# The classifier, the shingle hashes and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
