"""codeatlas - set-oriented Spark operators for code-and-issue data at repository scale."""

__version__ = "0.1.0"
