"""Every operator bound to the driver tables, and its SQL counterpart."""
