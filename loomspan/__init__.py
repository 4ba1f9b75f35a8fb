"""A graph analytics engine on Spark: typed node graphs compiled to DataFrame expressions."""
