"""Spark-native analytics over building plans, rule clauses and checker findings."""
