"""Column functions: times, texts, vectors and keys.  All are built-in expressions, so they stay in generated code."""
