"""folimetry: a PySpark engine that evaluates page recognition at cluster scale."""
