"""Training-data operators: the parts of a large text-corpus pipeline.

Nothing else in the library imports this subpackage.  Every operator is a function from DataFrames to DataFrames;
``weftspark.llm.queries`` holds the thin registered queries over them.
"""
