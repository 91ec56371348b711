"""stratalens: code-base and document analytics as Spark DataFrames."""
