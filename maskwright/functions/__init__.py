"""Column functions: span detection, masking, text and path helpers."""
