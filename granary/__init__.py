"""Granary: analytics over collections of files and documents on PySpark."""
