"""A Spark-first engine for multichannel time series, speech features and text corpora."""
