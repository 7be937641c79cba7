"""Analytics and retrieval over conversation and agent-session logs, on Spark DataFrames."""
