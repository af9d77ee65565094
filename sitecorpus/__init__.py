"""Turns stored web page snapshots into a clean, addressable text corpus with Spark."""
