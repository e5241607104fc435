"""Table operators: alignment, mapping, profiling, views."""
