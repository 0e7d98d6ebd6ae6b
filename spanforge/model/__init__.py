"""Byte models: label decoding and scans of windows."""
