"""tessera: a Spark-native engine for bilingual corpus preparation, checking and scoring."""
