"""Analytics over large typed dependency graphs, as Spark DataFrames."""
