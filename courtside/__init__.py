"""courtside: event-log analytics as Spark DataFrame-to-DataFrame functions."""
