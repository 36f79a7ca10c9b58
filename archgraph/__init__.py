"""archgraph: architecture graphs and corpus processing on Spark DataFrames."""
