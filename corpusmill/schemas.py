"""Schemas of files, chunks, datasets and results, as DDL."""

SOURCE = "struct<file_path:string,first_character_index:int,last_character_index:int>"
SOURCES = f"array<{SOURCE}>"
FILES = "file_path string, ext string, content string, line_offsets array<int>"
CHUNKS = "file_path string, ext string, position int, first_character_index int, last_character_index int, content string"
DIAGNOSTICS = "file_path string, kind string, message string"
#: One JSON document holds all questions; answered ones have sources and an answer.
DATASET = f"rag_questions array<struct<question_id:string,question:string,sources:{SOURCES},answer:string>>"
RESULTS = f"search_results array<struct<question_id:string,question:string,retrieved_sources:{SOURCES}>>, k int"
ANSWERS = f"search_results array<struct<question_id:string,question:string,retrieved_sources:{SOURCES},answer:string>>, k int"
