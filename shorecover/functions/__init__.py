"""Column-level functions: names, colours, geometry."""
