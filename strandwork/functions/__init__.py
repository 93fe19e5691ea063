"""Column functions over sequences, and seeded draws."""
