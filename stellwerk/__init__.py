"""Spark-first analytics over job postings: relational operators, text operators and reports."""
