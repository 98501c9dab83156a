"""Distributed operators: ordinal / count windows, sums of products, update rules,
metrics, scoring, logistic windows, ALS."""
