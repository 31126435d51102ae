"""Operators for large-scale training-data pipelines.

Nothing else in ``pulsefeat`` imports this subpackage; ``queries.py`` here lists what
``__spark_entry__.py`` registers.
"""
