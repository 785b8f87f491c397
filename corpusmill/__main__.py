"""python -m corpusmill COMMAND: index, search, search_dataset, answer, answer_dataset, evaluate, chunk_metrics."""

from __future__ import annotations

import argparse
import sys
import time

from corpusmill import pipeline as P
from corpusmill.errors import ChunkError, IndexingError, LoadError
from corpusmill.operators.bm25 import Index
from corpusmill.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill", description="Cut, index and search a corpus of text and source code.")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple[str, type, object]) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        for option, kind, default in options:
            c.add_argument(f"--{option}", type=kind, default=default, required=default is ...)
        return c

    k, index = ("k", int, 5), ("index", str, P.INDEX)
    command("index", "cut and index a folder", ("max_chunk_size", int, 2000), ("raw", str, P.RAW), index)
    command("search", "the best sources for a question", k, index).add_argument("query")
    command("search_dataset", "the best sources for a dataset", ("dataset_path", str, P.UNANSWERED), k, ("save_directory", str, f"{P.RESULTS}/UnansweredQuestions"), index)
    command("answer", "answer a question", k, index).add_argument("query")
    command("answer_dataset", "answer a dataset's search results", ("student_search_results_path", str, f"{P.RESULTS}/UnansweredQuestions"), ("save_directory", str, f"{P.ANSWERS}/UnansweredQuestions"), index)
    command("evaluate", "recall of search results", ("student_search_results_path", str, ...), ("dataset_path", str, ...), ("least", float, 0.5), ("max_context_length", int, 2000))
    command("chunk_metrics", "sizes of chunks", ("max_chunk_size", int, 2000), ("raw", str, P.RAW))
    return p


def run(args: list[str] | None = None) -> int:
    x = parser().parse_args(args)
    begun = time.time()
    try:
        spark = session()
        if x.command == "index":
            P.index(spark, x.raw, x.index, x.max_chunk_size)
            print(f"indexed in {time.time() - begun:.1f} s")
        elif x.command == "search":
            for row in Index(spark, x.index).ask(x.query, x.k).collect():
                print(f"{row['rank']}. {row.file_path} [{row.first_character_index}, {row.last_character_index}) {row.score:.3f}")
        elif x.command == "search_dataset":
            print(P.search_dataset(spark, x.dataset_path, x.k, x.save_directory, x.index))
        elif x.command == "answer":
            print(P.answer(spark, x.query, x.k, x.index))
        elif x.command == "answer_dataset":
            print(P.answer_dataset(spark, x.student_search_results_path, x.save_directory, x.index))
        elif x.command == "evaluate":
            row = P.evaluate(spark, x.student_search_results_path, x.dataset_path, x.least, x.max_context_length).first()
            print(*(f"{name}: {value}" for name, value in row.asDict().items()), sep="\n")
            return 0 if row.passed else 2
        else:
            P.chunk_metrics(spark, x.raw, x.max_chunk_size).show(truncate=False)
    except (LoadError, ChunkError, IndexingError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("stopped", file=sys.stderr)
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(run())
