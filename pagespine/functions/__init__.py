"""Column functions: URLs, typed coercion, value classes, text."""
