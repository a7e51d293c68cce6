"""corpusloom: analytics over crawled web corpora on Spark DataFrames."""
