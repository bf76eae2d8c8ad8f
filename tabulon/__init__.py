"""A relation engine on Spark: relational operators, lenient casts, schemas, encodings and interchange."""

__version__ = "0.1.0"
