"""weftgraph: evidence-backed dependency graphs over many repositories, on Spark DataFrames."""
