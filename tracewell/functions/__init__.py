"""Column-level building blocks: variant paths, transforms, measures, redaction."""
