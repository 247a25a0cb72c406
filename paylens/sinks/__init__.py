from paylens.sinks.writers import load_tables, register_views, stored_dimensions, stored_profile, write_bucketed, write_csv, write_table

__all__ = ["load_tables", "register_views", "stored_dimensions", "stored_profile", "write_bucketed", "write_csv", "write_table"]
