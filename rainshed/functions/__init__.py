"""Column functions: pure built-in expressions, so they stay inside whole-stage codegen."""
