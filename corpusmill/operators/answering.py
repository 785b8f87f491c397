"""Contexts for answers, and answers by a generator that can be replaced."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 2000
#: From question and context to an answer.
Generator = Callable[[str, str], str]


def contexts(results: DataFrame, texts: DataFrame, longest: int = CONTEXT) -> DataFrame:
    """question_id, context: the texts of each question's results, best first, with a blank line between, cut to `longest` characters."""
    begun = texts.select("chunk_id", F.substring("content", 1, longest).alias("content"))  # no more of any text can be in a context
    held = results.select("question_id", "rank", "chunk_id").join(begun, "chunk_id")
    of = held.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("parts"))
    return of.select("question_id", F.substring(F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n"), 1, longest).alias("context"))


def extract(question: str, context: str) -> str:
    """The best result's text, for want of a model."""
    return context.split("\n\n", 1)[0]


def answers(questions: DataFrame, held: DataFrame, generator: Generator = extract) -> DataFrame:
    """question_id, question, answer; a question without a context gets an empty answer."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["answer"] = [generator(q, c) if isinstance(c, str) else "" for q, c in zip(frame["question"], frame["context"])]
            yield frame[["question_id", "question", "answer"]]

    joined = questions.select("question_id", "question").dropDuplicates(["question_id"]).join(held, "question_id", "left")
    return joined.select("question_id", "question", "context").mapInPandas(rows, "question_id string, question string, answer string")
