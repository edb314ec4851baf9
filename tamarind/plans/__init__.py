"""Building blocks of physical plans: cutting lineage, skew, neighbours in an order."""
