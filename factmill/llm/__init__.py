"""Training-data operators: each is DataFrame -> DataFrame; nothing outside imports this package."""
