"""termloom: term analytics over document collections, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
