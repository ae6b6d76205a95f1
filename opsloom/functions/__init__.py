"""Column-level building blocks: every function here takes and returns Columns."""
