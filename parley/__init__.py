"""parley: transcript and annotation analytics on Spark."""
