"""A PySpark library for text, localisation and corpus analytics."""
