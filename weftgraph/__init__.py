"""weftgraph: a PySpark-native analytics engine for software-diagram data."""
