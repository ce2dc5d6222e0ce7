"""Column functions: text cleaning, tokens, numbers and fixed word lists."""
