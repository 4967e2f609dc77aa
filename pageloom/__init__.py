"""Web-content intelligence as Spark DataFrame and Structured Streaming operators."""
