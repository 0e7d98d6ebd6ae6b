"""Byte-span analytics on Apache Spark."""
