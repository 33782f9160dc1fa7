"""Price intelligence over Spark DataFrames: sources, matching, dedup, comparison, review, history, streams."""
