"""pulseloom: time-series, interval and beat analytics as plain PySpark DataFrame transformations."""
