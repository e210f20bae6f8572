"""Column expressions and label bands shared by the operators."""
