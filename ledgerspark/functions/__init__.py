"""Column expressions: dates, ageing, money, hashing and text."""
