"""Spark-native analytics for quantum-key-distribution networks.

Relational reporting, topology, telemetry, anomaly detection, forecasting and
document retrieval, each operator a function from DataFrames to a DataFrame.
"""
