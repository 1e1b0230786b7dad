"""Data preparation for bioactivity tables and text corpora on Spark."""
