"""Text facts as Spark columns: SQL where built-ins suffice, Arrow kernels elsewhere."""
