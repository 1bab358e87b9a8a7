"""Every source is a bounded table, so no streaming operators are built."""
