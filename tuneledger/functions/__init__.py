"""Column expressions shared by the operators and reports."""
