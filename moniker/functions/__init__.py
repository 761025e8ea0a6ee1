"""Column functions: names, cells, variants, scripts, tool calls."""
