"""Column expressions: geometry, palettes, gates and labels."""
