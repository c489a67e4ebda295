"""lociframe: genomic and tabular analytics as Spark DataFrames."""
