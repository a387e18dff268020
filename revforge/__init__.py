"""revforge: review-table preparation, labelling and evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
