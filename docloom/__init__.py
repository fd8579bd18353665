"""docloom: documents, vectors and knowledge graphs as Spark DataFrames."""
