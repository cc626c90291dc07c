"""marlspike: search, discovery and monitoring analytics on PySpark."""

__version__ = "0.1.0"
