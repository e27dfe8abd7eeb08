"""PySpark-native analytics engine: DataFrame-in / DataFrame-out operators."""
