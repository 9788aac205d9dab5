"""operators of the market analytics library."""
