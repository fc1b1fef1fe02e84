"""corrgraph: governed correspondence graphs and corpus operators on Spark DataFrames."""
