"""parley: chat-dataset preparation as Spark DataFrame operations."""
