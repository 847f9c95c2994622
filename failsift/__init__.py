"""Log triage and log search for CI jobs on Spark DataFrames."""

__version__ = "0.1.0"
