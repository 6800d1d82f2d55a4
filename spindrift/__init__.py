"""Analytics over wide feature tables, written as DataFrame operators for Spark."""
