"""tidemark: Spark-native analytics for market-style time series and the data around them."""

__version__ = "0.1.0"
