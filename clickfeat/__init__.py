"""Click-log features, splits, boosted-tree scoring and blends on Spark."""
