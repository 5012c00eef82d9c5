"""scorelake: evaluation analytics and event-log processing on Spark DataFrames."""

__version__ = "0.1.0"
