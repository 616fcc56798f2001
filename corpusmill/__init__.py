"""corpusmill: a PySpark engine for language-model corpora and evaluation data."""
