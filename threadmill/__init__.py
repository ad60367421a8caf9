"""threadmill: agent-session analytics on Spark DataFrames."""
