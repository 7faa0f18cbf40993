"""A versioned key-value engine on Spark: sequenced writes and deletes, immutable sorted runs, tiered merges."""
