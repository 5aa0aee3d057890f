"""Knowledge-graph building, validation, matching and retrieval on Spark DataFrames."""
