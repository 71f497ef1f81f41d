"""Delivery metrics from commit history, as Spark DataFrame operators."""
