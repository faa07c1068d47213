"""Reversible de-identification of data at scale, as PySpark DataFrame operators."""
