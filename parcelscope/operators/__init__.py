"""DataFrame operators over the whole portfolio."""
