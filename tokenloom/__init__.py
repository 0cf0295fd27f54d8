"""Spark jobs that prepare text for language models under token budgets."""
