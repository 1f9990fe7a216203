"""Text-reuse and edit-script analytics as PySpark DataFrame jobs."""

__version__ = "0.1.0"
