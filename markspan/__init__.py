"""State-space analytics of Petri nets, and array operators over token vectors, on Spark DataFrames."""
