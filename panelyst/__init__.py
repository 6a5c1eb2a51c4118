"""Panel time-series analytics expressed as lazy Spark plans."""
