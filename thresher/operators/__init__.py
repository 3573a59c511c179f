"""Operators over DataFrames: indexing, retrieval, ranking, crawling, keywords, topics and the knowledge graph."""
