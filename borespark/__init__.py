"""Spark-native analytics for well logs, wellbore tables, traces, gathers, horizons and velocity models."""
