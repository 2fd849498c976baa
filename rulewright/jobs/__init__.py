"""Programs for spark-submit: each reads tables, runs operators and writes tables."""
