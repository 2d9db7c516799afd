"""Seasonal demand analytics for order-level commerce data, as Spark jobs."""
