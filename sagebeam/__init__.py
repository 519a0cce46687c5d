"""Evidence ranking, dataset curation and validation on Spark DataFrames."""
