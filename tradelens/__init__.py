"""Prediction-market trader analytics as composable Spark DataFrame functions."""
