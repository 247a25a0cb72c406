"""Readers: JSON drops, flat tables, map features, and an order-and-lineitem star schema."""
