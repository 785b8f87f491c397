"""Question datasets, search results and answers as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from corpusmill.errors import LoadError
from corpusmill.schemas import ANSWERS, DATASET, RESULTS

#: Fields that may be missing or null.
_OPTIONAL = frozenset({"question_id", "sources", "answer"})


def _problems(value: object, kind: DataType, at: str, optional: frozenset[str]) -> list[str]:
    """Where a decoded JSON value isn't of its kind; whole numbers may be given as text."""
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            return [f"{at} is no object"]
        return [y for f in kind.fields if not (f.name in optional and value.get(f.name) is None) for y in _problems(value.get(f.name), f.dataType, f"{at}.{f.name}", optional)]
    if isinstance(kind, ArrayType):
        return [y for i, x in enumerate(value) for y in _problems(x, kind.elementType, f"{at}[{i}]", optional)] if isinstance(value, list) else [f"{at} is no list"]
    if isinstance(kind, IntegerType):
        whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer() or isinstance(value, str) and value.strip().lstrip("+-").isdigit()
        return [] if whole else [f"{at} is no whole number"]
    if isinstance(kind, StringType) and not isinstance(value, str):
        return [f"{at} is no text"]
    return []


def _cast(value: object, kind: DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _cast(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return [_cast(x, kind.elementType) for x in value]
    return int(value) if isinstance(kind, IntegerType) else value


def parse(document: str, schema: str, optional: frozenset[str] = _OPTIONAL) -> dict:
    """The document, checked against the schema; LoadError names all that is wrong."""
    import json

    kind = StructType.fromDDL(schema)
    try:
        value = json.loads(document)
    except ValueError as e:
        raise LoadError(f"this is no JSON: {e}") from e
    wrong = _problems(value, kind, "$", optional)
    if wrong:
        raise LoadError("; ".join(wrong[:20]))
    return _cast(value, kind)


def _read(spark: SparkSession, path: str, schema: str, optional: frozenset[str]) -> tuple[dict, DataFrame]:
    """A document is one JSON value and small: it is read whole, once, at the boundary."""
    found = spark.read.text(path, wholetext=True).collect()
    if not found:
        raise LoadError(f"there is nothing at {path}")
    value = parse(found[0].value, schema, optional)
    kind = StructType.fromDDL(schema)
    items = kind.fields[0]
    return value, spark.createDataFrame(value[items.name], items.dataType.elementType)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, sources, answer; a question without an id gets one, and unanswered ones have neither sources nor answer."""
    rows = _read(spark, path, DATASET, _OPTIONAL)[1]
    return rows.withColumn("question_id", F.coalesce("question_id", F.uuid()))


def read_results(spark: SparkSession, path: str, answers: bool = False) -> tuple[DataFrame, int]:
    """question_id, question, retrieved_sources (and answer), and k."""
    value, rows = _read(spark, path, ANSWERS if answers else RESULTS, frozenset())
    return rows, value["k"]


def nested(results: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, question, retrieved_sources: the located results of every question, best first; none is an empty list."""
    source = F.struct("file_path", "first_character_index", "last_character_index")
    lists = results.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("source")))), lambda x: x["source"]).alias("found"))
    rows = questions.select("question_id", "question").dropDuplicates(["question_id"]).join(lists, "question_id", "left")
    return rows.select("question_id", "question", F.coalesce("found", F.array().cast("array<struct<file_path:string,first_character_index:int,last_character_index:int>>")).alias("retrieved_sources"))


def exploded(rows: DataFrame) -> DataFrame:
    """question_id, rank, file_path, first, last of nested results."""
    each = rows.select("question_id", F.posexplode("retrieved_sources").alias("at", "s"))
    return each.select("question_id", (F.col("at") + 1).alias("rank"), F.col("at").cast("bigint").alias("chunk_id"), "s.file_path", F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last"))


def write_results(rows: DataFrame, k: int, path: str) -> None:
    """Writes one JSON document with all rows and k, as a folder with one file of text."""
    items = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), "question_id").orderBy("question_id").select("value")
    whole = items.agg(F.array_join(F.collect_list("value"), ",\n").alias("value"))  # the document is one value by definition
    whole.select(F.concat(F.lit('{"search_results": [\n'), "value", F.lit(f'\n], "k": {k}}}')).alias("value")).coalesce(1).write.mode("overwrite").text(path)
