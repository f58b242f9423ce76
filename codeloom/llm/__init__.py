"""Operators for preparing language-model training data, one module each.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
