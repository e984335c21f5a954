"""Authorization analytics on Spark: permission schemas compiled to DataFrame plans."""
