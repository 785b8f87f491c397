"""From a folder of files to an index, and from questions to results, answers and recall."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import answering, chunking, evaluation, metrics, order
from corpusmill.operators.bm25 import Index
from corpusmill.sources import datasets
from corpusmill.sources.corpus import load_files
from corpusmill.storage import cut

RAW, INDEX = "data/raw", "data/processed"
UNANSWERED = "data/datasets/UnansweredQuestions/dataset_docs_public.json"
RESULTS, ANSWERS = "data/output/search_results", "data/output/search_results_and_answer"


def index_files(files: DataFrame, folder: str = INDEX, limit: int = chunking.LIMIT) -> Index:
    """Cuts the files and replaces the index in `folder`."""
    chunks = order.number_chunks(chunking.chunk_files(chunking.require_files(files), chunking.checked_limit(limit)))
    return Index(files.sparkSession, folder).build(chunks.select("chunk_id", "file_path", "first_character_index", "last_character_index", "content"))


def index(spark: SparkSession, raw: str = RAW, folder: str = INDEX, limit: int = chunking.LIMIT) -> Index:
    """The same with the files below `raw`."""
    return index_files(load_files(spark, raw), folder, limit)


def search_dataset(spark: SparkSession, dataset: str = UNANSWERED, k: int = 5, save: str = f"{RESULTS}/UnansweredQuestions", folder: str = INDEX) -> str:
    """Writes the k best sources of every question of a dataset; gives the path."""
    questions = cut(datasets.read_questions(spark, dataset))  # ids that were missing are made once
    rows = datasets.nested(Index(spark, folder).search(questions, k), questions)
    to = f"{save}/{PurePosixPath(dataset).name}"
    datasets.write_results(rows, k, to)
    return to


def answer_dataset(spark: SparkSession, results: str, save: str = f"{ANSWERS}/UnansweredQuestions", folder: str = INDEX, generator: answering.Generator = answering.extract) -> str:
    """Writes an answer beside the sources of every question; gives the path."""
    rows, k = datasets.read_results(spark, results)
    built = Index(spark, folder)
    key = ["file_path", "first_character_index", "last_character_index"]
    found = datasets.exploded(rows).drop("chunk_id").withColumnsRenamed({"first": key[1], "last": key[2]}).join(built.table("metadata"), key)
    replies = answering.answers(rows, answering.contexts(found, built.table("texts")), generator)
    to = f"{save}/{PurePosixPath(results).name}"
    datasets.write_results(rows.join(replies.select("question_id", "answer"), "question_id").select("question_id", "question", "retrieved_sources", "answer"), k, to)
    return to


def answer(spark: SparkSession, question: str, k: int = 5, folder: str = INDEX, generator: answering.Generator = answering.extract) -> str:
    """The answer to one question."""
    built = Index(spark, folder)
    context = answering.contexts(built.ask(question, k), built.table("texts")).first()
    return generator(question, context.context) if context else ""


def evaluate(spark: SparkSession, results: str, dataset: str, least: float = evaluation.CODE_LEAST, context: int = evaluation.CONTEXT) -> DataFrame:
    """One row: mean recall at each depth, and whether that at five reaches `least`.  Sources longer than the context don't count."""
    found, _ = datasets.read_results(spark, results)
    retrieved = datasets.exploded(found)
    retrieved = retrieved.exceptAll(evaluation.too_long(retrieved, context))
    correct = evaluation.correct_sources(datasets.read_questions(spark, dataset))
    if correct.isEmpty():
        raise datasets.LoadError(f"{dataset} has no question with sources")
    return evaluation.verdict(evaluation.recall(retrieved, correct), least)


def chunk_metrics(spark: SparkSession, raw: str = RAW, limit: int = chunking.LIMIT) -> DataFrame:
    """Sizes of the chunks of each kind of file below `raw`."""
    files = load_files(spark, raw)
    return metrics.chunk_metrics(chunking.chunk_files(files, chunking.checked_limit(limit)), files)
