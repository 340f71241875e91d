"""Column expressions: numbers, rates, prices, text and URLs."""
