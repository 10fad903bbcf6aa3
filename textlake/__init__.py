"""textlake: text analytics as plain DataFrame plans on Spark."""
