"""plans of the market analytics library."""
