"""Changes of tables, and nearest-neighbour search."""
