"""Screening and evaluation of daily bars as Spark DataFrame plans, and training-data operators beside it (`llm`)."""
