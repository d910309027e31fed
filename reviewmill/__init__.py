"""Spark jobs for review labelling and product-catalog tables."""
