"""vecprobe: Spark-native preparation, retrieval and statistical evaluation of
text and embedding tables.

Operators take and return DataFrames. Vectors are ``array<float|double>``
columns, texts are string columns; nothing here runs a model.
"""

__version__ = "0.1.0"
