"""Training-data operators for very large text corpora.

Nothing else in the library imports this subpackage.  Every operator is a function over DataFrames;
``queries`` holds the thin query wrappers that the driver entry registers.
"""
