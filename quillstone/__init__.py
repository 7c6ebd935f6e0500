"""quillstone: a Spark-native engine for preparing and auditing document corpora."""
