"""Column expressions: text cleaning, tokenisation, word lists."""
