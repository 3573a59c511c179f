"""Text retrieval, link analysis and knowledge-graph queries on Spark DataFrames."""
