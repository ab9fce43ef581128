"""functions of factmill."""
