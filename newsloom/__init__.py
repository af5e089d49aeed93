"""Event-news analytics and training-data preparation as composable Spark operators."""
