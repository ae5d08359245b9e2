"""Time-ordered log records on Spark: store, search, tail and upkeep, declared as DataFrame plans."""
