"""functions of the market analytics library."""
