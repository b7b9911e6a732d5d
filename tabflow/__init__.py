"""tabflow: table profiling, cleaning, feature engineering, splitting and model
evaluation expressed as Spark DataFrame transformations."""

__version__ = "0.1.0"
