"""Coverage of the correct sources of `rag_questions` by `search_results`, and sizes of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, metrics
from corpusmill.plans.tables import table, wide


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieved_sources(table(spark, sf_dir, "search_results"))


def _correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.correct_sources(table(spark, sf_dir, "rag_questions"))


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(evaluation.answered(table(spark, sf_dir, "rag_questions")).select("question_id", "question", F.size("sources").alias("n_sources"), "answer"))


def correct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(_correct(spark, sf_dir))


def retrieved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(_retrieved(spark, sf_dir))


def long_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(evaluation.too_long(_retrieved(spark, sf_dir)))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(evaluation.overlaps(_retrieved(spark, sf_dir), _correct(spark, sf_dir)))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall(_retrieved(spark, sf_dir), _correct(spark, sf_dir))


def recall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict(recall_at_k(spark, sf_dir))


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").withColumn("ext", F.element_at(F.split("file_path", r"\."), -1))
    return wide(metrics.chunk_metrics(chunks, table(spark, sf_dir, "files")))


QUERIES = {f.__name__: f for f in (answered_questions, correct_sources, retrieved_topk, long_sources, overlap_join, recall_at_k, recall_verdict, chunk_metrics)}

_TOP = """
    best as (select question_id, chunk_id, max(score) as score, min(file_path) as file_path, min(first_character_index)::bigint as first, min(last_character_index)::bigint as last
             from search_results where question_id is not null and chunk_id is not null and score is not null and not isnan(score) group by question_id, chunk_id),
    retrieved as (select * exclude (score) from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from best) where rank <= 10)"""
_CORRECT = """
    each as (select question_id, unnest(sources) as s from rag_questions where question_id is not null),
    correct as (select distinct question_id, s.file_path as file_path, s.first_character_index::bigint as first, s.last_character_index::bigint as last from each
                where s.file_path is not null and s.first_character_index is not null and s.last_character_index is not null)"""
_OVERLAP = f"""{_TOP}, {_CORRECT},
    overlap as (select r.question_id, r.chunk_id, r.rank, c.file_path, c.first, c.last from retrieved r join correct c
                on r.question_id = c.question_id and r.file_path = c.file_path and r.first < c.last and c.first < r.last)"""
_RECALL = f"""{_OVERLAP},
    ranks as (select question_id, file_path, first, last, min(rank) as rank from overlap group by all),
    recall as (select question_id, count(*) as n_sources, {", ".join(f"round(count(*) filter (rank <= {k}) / count(*), 6) as recall_at_{k}" for k in evaluation.DEPTHS)}
               from correct left join ranks using (question_id, file_path, first, last) group by question_id)"""

SQL = {
    "answered_questions": "select question_id, question, len(sources)::bigint as n_sources, answer from (select distinct * from rag_questions) where sources is not null and answer is not null",
    "correct_sources": f"with {_CORRECT} select * from correct",
    "retrieved_topk": f"with {_TOP} select * from retrieved",
    "long_sources": f"with {_TOP} select * from retrieved where last - first > 2000",
    "overlap_join": f"with {_OVERLAP} select * from overlap",
    "recall_at_k": f"with {_RECALL} select * from recall",
    "recall_verdict": f"""
        with {_RECALL} select count(*) as n_questions, {", ".join(f"round(avg(recall_at_{k}), 6) as recall_at_{k}" for k in evaluation.DEPTHS)}, coalesce(round(avg(recall_at_5), 6) >= 0.5, false) as passed from recall""",
    "chunk_metrics": """
        with sizes as (select string_split(file_path, '.')[-1] as ext, last_character_index - first_character_index as size from chunks where last_character_index is not null and first_character_index is not null),
        held as (select ext, count(*) as n_files from (select distinct file_path, ext from files) group by ext)
        select ext, count(*) as n_chunks, min(size)::bigint as min_size, max(size)::bigint as max_size, round(avg(size), 6) as avg_size, median(size)::double as median_size, any_value(n_files) as n_files, round(count(*) / any_value(n_files), 6) as chunks_per_file
        from sizes join held using (ext) group by ext""",
}
