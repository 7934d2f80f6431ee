"""Mass-univariate linear models on Spark: one design, very many responses, each with its own missing data."""
