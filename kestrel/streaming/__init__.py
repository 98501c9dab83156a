"""Structured Streaming drivers: model table, GLM train/predict, ALS retraining."""
