"""seiche: Spark-first operators for sensor series, event catalogues and the files they arrive in."""

__version__ = "0.1.0"
