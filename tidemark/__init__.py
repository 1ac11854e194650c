"""Panel analytics, content timelines, experiment scoring and candidate search on Spark."""
