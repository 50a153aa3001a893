"""Spark operators and jobs for the supply of places over a territory."""
