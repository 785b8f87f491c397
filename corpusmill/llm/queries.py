"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.contamination import contaminated
from corpusmill.llm.documentation import documented_names
from corpusmill.llm.encoding import restored
from corpusmill.llm.origin import not_handwritten
from corpusmill.llm.packing import packed
from corpusmill.llm.splitting import split_chunks
from corpusmill.llm.topk import best_chunks
from corpusmill.llm.windows import shared_passages


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_names(spark.read.parquet(f"{sf_dir}/files.parquet"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_chunks(spark.read.parquet(f"{sf_dir}/chunks.parquet"), spark.read.parquet(f"{sf_dir}/index_runs.parquet"))
    return pieces.where("piece = 1").select("chunk_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(spark.read.parquet(f"{sf_dir}/files.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_chunks(spark.read.parquet(f"{sf_dir}/search_results.parquet")).select("question_id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/chunks.parquet")).select("chunk_id_a", "chunk_id_b")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/containers.parquet"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p6_packed, p7_found, p8_found)}

SQL: dict[str, str] = {
    "p2_found": """
        select distinct chunk_id from chunks join index_runs using (run_id) where length(content) > coalesce(max_chunk_size, 2000)""",
    "p4_found": """
        select question_id, chunk_id from (
            select *, row_number() over (partition by question_id order by score desc, chunk_id) as place from (
                select question_id, chunk_id, max(score) as score, max(k) as k from search_results
                where question_id is not null and chunk_id is not null and score is not null and not isnan(score)
                group by question_id, chunk_id))
        where place <= k""",
    "p5_found": """
        with windows as (select distinct chunk_id, substr(content, i, 200) as passage from (select chunk_id, content, unnest(range(1, length(content) - 198)) as i from chunks where content is not null))
        select distinct a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b from windows a join windows b on a.passage = b.passage and a.chunk_id < b.chunk_id""",
    "p7_found": r"""
        with words as (
            select 'doc' as kind, doc_id as id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents where doc_id is not null
            union all
            select 'item', item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) from benchmark where item_id is not null),
        windows as (select distinct kind, id, array_to_string(w[i:i + 11], ' ') as passage from (select kind, id, w, unnest(range(1, len(w) - 10)) as i from words))
        select distinct d.id as doc_id, i.id as item_id from windows d join windows i using (passage) where d.kind = 'doc' and i.kind = 'item'""",
}
