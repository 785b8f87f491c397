"""Queries over the driver's tables, one for each of the reference's own operators, and their SQL."""

from corpusmill.plans import evaluation_queries, retrieval_queries, span_queries

QUERIES = span_queries.QUERIES | retrieval_queries.QUERIES | evaluation_queries.QUERIES
SQL = span_queries.SQL | retrieval_queries.SQL | evaluation_queries.SQL
