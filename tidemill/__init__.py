"""Feature engineering, training-set assembly and model monitoring on Spark.

Every operator is a function from DataFrame to DataFrame (or a builder of
``Column`` expressions), so the same code runs on batch and streaming input
wherever Structured Streaming allows it.
"""

__version__ = "0.1.0"
