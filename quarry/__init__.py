"""quarry: graph, statistical and transactional analytics on Spark DataFrames."""

__version__ = "0.1.0"
