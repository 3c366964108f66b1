"""Declared tables on Spark: audit, diff, classify, apply and watch tables and streams."""
