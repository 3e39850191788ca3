"""Property acquisition analytics as DataFrame transformations on Spark."""
