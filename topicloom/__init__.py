"""topicloom: a PySpark-native text-mining engine.

Finds recurring topics and references in large, noisy document
collections: text cleaning, tf-idf keywords, windowed n-gram counts,
PMI coherence, word vectors and clustering, run ranking and dated
co-mention time series. Every job is a function from DataFrames to a
DataFrame; Spark plans and runs the work.
"""

__version__ = "0.1.0"
