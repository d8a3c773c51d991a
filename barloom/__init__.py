"""barloom: panel factors, baskets and signal evaluation as Spark DataFrame operators."""
