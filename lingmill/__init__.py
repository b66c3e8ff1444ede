"""Spark-first language identification: train, store, apply and evaluate models as DataFrame plans."""

__version__ = "0.1.0"
