"""Column functions: text, URLs, money and attributes."""
