"""Spans of the rows of `files` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunking, order, spans
from corpusmill.plans.tables import table, wide

_LIMIT, _PACKED = 2000, 500

_NL = r"\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
_SP = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FENCE = r"^ {0,3}(`{3,}|~{3,})"


def _line_ctes(where: str = "true") -> str:
    """CTE `o`: the lines of files with their spans and what they could be in Markdown."""
    return rf"""
    f as (select distinct file_path, ext, content from files where content is not null and {where}),
    p as (select file_path, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as line
          from (select file_path, regexp_extract_all(content, '[^{_NL}]*(?:\r\n|[{_NL}])|[^{_NL}]+') as pieces from f)),
    l as (select file_path, line, length(piece) as size, regexp_replace(piece, '[\r\n]+$', '') as text from p),
    o as (select file_path, line, size, text, coalesce(sum(size) over (partition by file_path order by line rows between unbounded preceding and 1 preceding), 0)::bigint as first,
                 coalesce(sum(size) over (partition by file_path order by line rows between unbounded preceding and 1 preceding), 0)::bigint + length(text) as last,
                 regexp_matches(text, '^[{_SP}]*$') as blank, regexp_extract(text, '{_FENCE}', 1) as mark,
                 regexp_matches(text, '^ {{0,3}}#{{1,6}}(?:[{_SP}]|$)') as header,
                 regexp_matches(regexp_replace(text, '{_FENCE}', ''), '^[{_SP}]*$') as bare
          from l)"""


def _packed(source: str, name: str, limit: int, key: str) -> str:
    """CTE `name`: neighbours of `source` (key, place from 0, first, last) packed within the limit."""
    return f"""
    {name}_walk as (
        select {key}, place, first as start, last from {source} where place = 0
        union all
        select n.{key.replace(", ", ", n.")}, n.place, case when n.last - w.start <= {limit} then w.start else n.first end, n.last
        from {name}_walk w join {source} n on {" and ".join(f"n.{k} = w.{k}" for k in key.split(", "))} and n.place = w.place + 1),
    {name} as (select {key}, start as first, max(last) as last from {name}_walk group by {key}, start)"""


_KINDS = """
    kinds as (
        select file_path, line, first, last, kind, case when kind = 'open' then substr(mark, 1, 1) end as mark_char, case when kind = 'open' then length(mark) end as mark_length from (
            select *, case when mark <> '' then 'open' when header then 'header' when blank then 'blank' else 'text' end as kind from o where line = 0)
        union all
        select file_path, line, first, last, kind, case when kind in ('open', 'code') then coalesce(mark_char, substr(mark, 1, 1)) end, case when kind in ('open', 'code') then coalesce(mark_length, length(mark)) end from (
            select o.*, k.mark_char, k.mark_length,
                   case when k.mark_char is not null then case when o.mark <> '' and substr(o.mark, 1, 1) = k.mark_char and length(o.mark) >= k.mark_length and o.bare then 'close' else 'code' end
                        when o.mark <> '' then 'open' when o.header then 'header' when o.blank then 'blank' else 'text' end as kind
            from kinds k join o on o.file_path = k.file_path and o.line = k.line + 1))"""


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spans.line_spans(table(spark, sf_dir, "files")).select("file_path", "line", "first"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spans.line_spans(table(spark, sf_dir, "files")))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spans.paragraph_spans(table(spark, sf_dir, "files")))


def md_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spans.line_marks(table(spark, sf_dir, "files").where("ext = 'md'")))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spans.text_windows(table(spark, sf_dir, "documents"), "doc_id", "text", _LIMIT))


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(chunking.spans(table(spark, sf_dir, "files"), "md", "packed lines", _PACKED))


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(chunking.spans(table(spark, sf_dir, "files"), "md", "sections"))


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(chunking.spans(table(spark, sf_dir, "files"), "md", "blocks"))


def py_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(chunking.spans(table(spark, sf_dir, "files"), "py", "definitions"))


def _chunks(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    rows = chunking.chunk_files(table(spark, sf_dir, "files").where(F.col("ext") == ext), _LIMIT)
    return wide(rows.select("file_path", F.col("first_character_index").alias("first"), F.col("last_character_index").alias("last"), "content"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "txt")


def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "md")


def py_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "py")


def union_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all files with their ids."""
    rows = order.number_chunks(chunking.chunk_files(table(spark, sf_dir, "files"), _LIMIT))
    return wide(rows.select("chunk_id", "file_path", "first_character_index", "last_character_index"))


def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.diagnostics(table(spark, sf_dir, "files"), _LIMIT)


def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the table whose content is the slice of their file that they name."""
    files = table(spark, sf_dir, "files").where("content is not null").select("file_path", F.col("content").alias("whole")).dropDuplicates(["file_path"])
    chunks = table(spark, sf_dir, "chunks").where("last_character_index is not null")
    piece = F.expr("substring(whole, first_character_index + 1, last_character_index - first_character_index)")
    return chunks.join(files, "file_path").where(piece == F.col("content")).select("chunk_id", F.length("content").cast("bigint").alias("size"))


QUERIES = {f.__name__: f for f in (line_offsets, line_spans, paragraph_spans, md_fences, sliding_windows, greedy_pack, md_sections, md_blocks, py_units, text_chunks, md_chunks, py_chunks, union_chunks, chunk_diagnostics, chunk_slices)}

_PARAGRAPHS = """
    islands as (select *, sum(case when blank then 1 else 0 end) over (partition by file_path order by line) as island from o),
    paragraphs as (select file_path, min(first) as first, max(last) as last from islands where not blank group by file_path, island)"""

SQL = {
    "line_offsets": """
        select distinct file_path, (generate_subscripts(line_offsets, 1) - 1)::bigint as line, unnest(line_offsets)::bigint as first from files where content is not null""",
    "line_spans": f"with {_line_ctes()} select file_path, line::bigint as line, first, last from o",
    "paragraph_spans": f"with {_line_ctes()}, {_PARAGRAPHS} select file_path, first, last from paragraphs",
    "md_fences": f"""
        with {_line_ctes("ext = 'md'")} select file_path, line::bigint as line, case when mark <> '' then substr(mark, 1, 1) end as fence_char, case when mark <> '' then length(mark) end as fence_len, header from o""",
    "sliding_windows": f"""
        select doc_id, (i * {_LIMIT - _LIMIT // 10})::bigint as first, least(i * {_LIMIT - _LIMIT // 10} + {_LIMIT}, length(text))::bigint as last
        from documents, unnest(range(case when length(text) = 0 then 0 else ceil(greatest(length(text) - {_LIMIT}, 0) / {_LIMIT - _LIMIT // 10})::bigint + 1 end)) as t(i)
        where text is not null""",
    "greedy_pack": f"""
        with recursive {_line_ctes("ext = 'md'")}, n as (select file_path, line as place, first, last from o), {_packed("n", "packed", _PACKED, "file_path")}
        select file_path, first, last from packed""",
    "md_sections": f"""
        with recursive {_line_ctes("ext = 'md'")}, {_KINDS},
        cuts as (select file_path, first from kinds where kind = 'header' union select file_path, 0 from f where content <> '')
        select file_path, first::bigint as first, coalesce(lead(first) over (partition by file_path order by first), length(content))::bigint as last from cuts join f using (file_path)""",
    "md_blocks": f"""
        with recursive {_line_ctes("ext = 'md'")}, {_KINDS},
        begun as (select *, case when kind = 'open' or (kind in ('text', 'header') and coalesce(lag(kind) over (partition by file_path order by line), 'blank') in ('blank', 'close')) then 1 else 0 end as fresh from kinds),
        grouped as (select *, sum(fresh) over (partition by file_path order by line) as block from begun)
        select file_path, min(first)::bigint as first, max(last)::bigint as last from grouped where kind <> 'blank' group by file_path, block""",
    "text_chunks": f"""
        with recursive {_line_ctes("ext = 'txt'")}, {_PARAGRAPHS},
        placed as (select *, row_number() over (partition by file_path order by first) - 1 as place from paragraphs), {_packed("placed", "blocks", _LIMIT, "file_path")},
        inner_lines as (select b.file_path, b.first as block, o.first, o.last, row_number() over (partition by b.file_path, b.first order by o.first) - 1 as place
                        from blocks b join o on o.file_path = b.file_path and o.first >= b.first and o.last <= b.last where b.last - b.first > {_LIMIT}),
        {_packed("inner_lines", "line_blocks", _LIMIT, "file_path, block")},
        spans as (
            select file_path, first, last from blocks where last - first <= {_LIMIT}
            union all
            select file_path, first, last from line_blocks where last - first between 1 and {_LIMIT}
            union all
            select file_path, first + i * {_LIMIT - _LIMIT // 10}, least(first + i * {_LIMIT - _LIMIT // 10} + {_LIMIT}, last)
            from line_blocks, unnest(range(ceil((last - first - {_LIMIT}) / {_LIMIT - _LIMIT // 10})::bigint + 1)) as t(i) where last - first > {_LIMIT})
        select s.file_path, s.first::bigint as first, s.last::bigint as last, substr(content, (s.first + 1)::bigint, (s.last - s.first)::bigint) as content from spans s join f using (file_path)""",
    "chunk_slices": """
        select chunk_id, length(c.content)::bigint as size
        from chunks c join (select distinct file_path, content from files where content is not null) f using (file_path)
        where last_character_index is not null and substr(f.content, first_character_index + 1, last_character_index - first_character_index) = c.content""",
}
