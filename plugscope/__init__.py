"""Attack-surface analytics over PHP plugin corpora, on PySpark."""
