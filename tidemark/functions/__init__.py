"""Column expressions shared by the customer operators."""
