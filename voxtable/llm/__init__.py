"""Operators of a training-data pipeline; nothing else in voxtable imports this package."""
