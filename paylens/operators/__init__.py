"""DataFrame-to-DataFrame operators; columns, years and k are always parameters."""
