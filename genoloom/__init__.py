"""genoloom: sequence, annotation and corpus analytics as plain Spark DataFrames."""
