"""tagsmith: labels and anomaly scores for tabular data, as Spark plans."""

__version__ = "0.1.0"
