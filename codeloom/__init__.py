"""A PySpark engine for querying program structure as data."""
