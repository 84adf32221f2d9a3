"""Named queries: a Spark form and, where SQL can express it, an equivalent SQL text."""
