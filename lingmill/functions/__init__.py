"""Column functions and catalogues."""
