"""Factor functions: row-wise, rolling, and recursive."""
