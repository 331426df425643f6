"""quarry: Spark-native analytics for assessing and preparing training datasets."""
