"""Spark-native code-graph analytics: source trees to tables, graphs, chunks and answers."""
