"""vecloom: Spark-native embedding analytics and music-corpus curation."""
