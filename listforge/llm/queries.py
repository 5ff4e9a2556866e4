"""Every query of this subpackage, by name, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from listforge.llm import q_chat, q_documents, q_pages, q_vectors

QUERIES = {**q_chat.QUERIES, **q_documents.QUERIES, **q_pages.QUERIES, **q_vectors.QUERIES}
ORACLE = {**q_chat.ORACLE, **q_documents.ORACLE, **q_vectors.ORACLE}
