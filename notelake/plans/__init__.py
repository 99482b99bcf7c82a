"""The two expression languages, compiled to Spark columns on the driver."""
