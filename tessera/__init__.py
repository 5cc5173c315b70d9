"""tessera: retrieval, corpus preparation and snapshot lifecycle on Spark DataFrames."""
