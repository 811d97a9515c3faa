"""Column functions: vocabulary, encodings, hashing, metrics."""
