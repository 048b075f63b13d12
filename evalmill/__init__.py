"""evalmill: Spark jobs for the data work around tool-calling models."""
