"""gridloom: a registry of physical places, built and queried with plain Spark DataFrames."""
