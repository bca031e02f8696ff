"""Operators of a training-data pipeline.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when the folder is present.
"""
