"""streaming of the market analytics library."""
