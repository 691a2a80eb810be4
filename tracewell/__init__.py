"""tracewell: agent-trace analytics as ordinary Spark DataFrames."""

__version__ = "0.1.0"
