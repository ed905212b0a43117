"""docloom: a Spark-native engine for reading and analysing document corpora."""
