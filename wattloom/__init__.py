"""wattloom: Spark DataFrame operators for large energy time series."""
