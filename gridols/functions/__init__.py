"""Mass-univariate linear models on Spark."""
