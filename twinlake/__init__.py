"""twinlake: near-duplicate and containment analytics on Spark DataFrames."""
