"""Conversation measurement jobs on Spark: logs in, scored and explained runs out."""
