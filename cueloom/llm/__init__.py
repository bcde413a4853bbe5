"""Training-data operators: text, pages and vectors at corpus scale.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries
only where it is present.
"""
