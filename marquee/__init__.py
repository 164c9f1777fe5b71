"""Content analytics on Spark: item, user and tag tables, and the questions asked of them."""
