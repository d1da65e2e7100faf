"""Inkfield: Spark-first analytics for corpora of programs paired with rendered figures."""
