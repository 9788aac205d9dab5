"""sources of the market analytics library."""
