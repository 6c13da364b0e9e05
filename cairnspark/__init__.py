"""A PySpark engine for cataloguing, packaging and searching document collections."""
