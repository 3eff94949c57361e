"""groundline: evidence retrieval and answer grounding as Spark DataFrame jobs."""
