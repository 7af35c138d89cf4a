"""quarry: a PySpark-native code-, graph- and corpus-analytics engine."""
