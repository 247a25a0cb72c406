"""Whole plans: the model, the business cases, the explorer and the load."""
