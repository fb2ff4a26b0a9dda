"""Column functions and stemming as column expressions."""
