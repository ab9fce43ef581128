"""sources of factmill."""
