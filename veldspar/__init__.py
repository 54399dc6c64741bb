"""PySpark-native engine for document corpora, screening rules and multi-criteria indices."""
