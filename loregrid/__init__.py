"""Text retrieval, knowledge-base and text-ingestion operators on Spark DataFrames."""
