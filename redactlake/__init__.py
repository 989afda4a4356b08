"""redactlake: document de-identification on Spark DataFrames."""
