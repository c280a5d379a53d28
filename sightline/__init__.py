"""Spark-native analytics over time-stamped evidence, intervals, transcripts, frames and audits."""
