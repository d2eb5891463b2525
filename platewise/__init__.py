"""Spark jobs for food-ordering analytics: orders, reviews, forecasts, menus."""
