"""argloom: argument-analysis verification, scoring and preference data on Spark."""
