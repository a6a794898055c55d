"""weftspark: dense distributed arrays, transforms and array files as Spark DataFrames."""
