"""A Spark-native analytics engine: relational workbench, change log, catalogue, text and study analytics."""
