"""Operators for large-scale training-data pipelines.

Of the rest of the library only the evaluation of searches imports from it, for
its intermediate table; it depends only on PySpark, numpy and pyarrow.
"""
