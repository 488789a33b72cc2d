"""Column functions: text, paths, locals, classification, diffs and frame predicates."""
