"""Request-driven analysis of labelled sensor data on PySpark."""
