"""How well retrieved sources cover the correct ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.bm25 import top_k

DEPTHS = (1, 3, 5, 10)
#: Shares of correct sources that must be found among five.
CODE_LEAST, DOCS_LEAST = 0.5, 0.8
#: Longest source that counts, in characters.
CONTEXT = 2000


def answered(questions: DataFrame) -> DataFrame:
    """The questions that have sources and an answer; a question that is given again counts once."""
    return questions.where("sources is not null and answer is not null").dropDuplicates(["question_id"])


def correct_sources(questions: DataFrame) -> DataFrame:
    """question_id, file_path, first, last: the distinct correct sources of every question that has any."""
    rows = questions.where("question_id is not null").select("question_id", F.explode("sources").alias("s"))
    return rows.select("question_id", "s.file_path", F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last")).where("file_path is not null and first is not null and last is not null").distinct()


def retrieved_sources(results: DataFrame, k: int = max(DEPTHS)) -> DataFrame:
    """question_id, rank, chunk_id, file_path, first, last: the k best candidates of each question, each with its highest score.

    Rows without question, chunk or score (null or NaN) don't count.
    """
    rows = results.where("question_id is not null and chunk_id is not null and score is not null and not isnan(score)")
    best = rows.groupBy("question_id", "chunk_id").agg(
        F.max("score").alias("score"), F.min("file_path").alias("file_path"), F.min("first_character_index").alias("first"), F.min("last_character_index").alias("last")
    )
    return top_k(best, "question_id", k).select("question_id", "rank", "chunk_id", "file_path", "first", "last")


def too_long(retrieved: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The retrieved sources that are longer than the context allows."""
    return retrieved.where(F.col("last") - F.col("first") > context)


def overlaps(retrieved: DataFrame, correct: DataFrame) -> DataFrame:
    """question_id, chunk_id, rank, file_path, first, last: retrieved with the correct source (first, last) of the same file that it overlaps; touching is no overlap."""
    r, c = retrieved.alias("r"), correct.alias("c")
    near = (F.col("r.question_id") == F.col("c.question_id")) & (F.col("r.file_path") == F.col("c.file_path")) & (F.col("r.first") < F.col("c.last")) & (F.col("c.first") < F.col("r.last"))
    return r.join(c, near).select("r.question_id", "r.chunk_id", "r.rank", "c.file_path", F.col("c.first").alias("first"), F.col("c.last").alias("last"))


def recall(retrieved: DataFrame, correct: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """question_id, n_sources, recall_at_k...: the share of each question's correct sources that its k best results overlap.

    Questions without a correct source have no row; those without a result have 0.
    """
    key = ["question_id", "file_path", "first", "last"]
    ranks = overlaps(retrieved, correct).groupBy(*key).agg(F.min("rank").alias("rank"))
    found = correct.join(ranks, key, "left")
    return found.groupBy("question_id").agg(F.count("*").alias("n_sources"), *[F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in depths])


def verdict(per_question: DataFrame, least: float = CODE_LEAST, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """n_questions, the mean recall at each depth, and whether that at five reaches `least`: one row."""
    means = per_question.agg(F.count("*").alias("n_questions"), *[F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in depths])
    return means.withColumn("passed", F.coalesce(F.col("recall_at_5") >= least, F.lit(False)))
