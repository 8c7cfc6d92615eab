"""quern: a Spark-native engine for source-control activity and training-corpus work."""
