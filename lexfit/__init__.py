"""Term-fit analytics for HTML pages and texts, written as PySpark DataFrame operators."""
