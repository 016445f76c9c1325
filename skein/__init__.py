"""skein: batch analytics over speaker-attributed conversations, as Spark DataFrame operations."""
