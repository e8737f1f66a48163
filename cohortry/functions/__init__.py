"""Column expressions with the null, date and rounding rules used everywhere."""
