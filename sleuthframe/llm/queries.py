"""All queries of this subpackage, with the SQL that they are held against."""

from __future__ import annotations

from sleuthframe.llm import queries_corpus, queries_digest, queries_match, queries_score

MODULES = (queries_digest, queries_match, queries_score, queries_corpus)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
