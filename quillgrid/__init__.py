"""Full-text indexing and search over document collections on PySpark."""
