"""Row-level expressions and the formula language."""
