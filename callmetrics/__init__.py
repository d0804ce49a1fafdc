"""callmetrics: a PySpark-native engine for function-calling datasets and predictions."""
