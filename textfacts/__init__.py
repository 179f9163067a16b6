"""textfacts: deterministic Unicode text facts as Spark columns and DataFrame operators."""

__version__ = "0.1.0"
