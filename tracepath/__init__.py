"""tracepath: why work finished when it did, as Spark DataFrames."""
