"""Empty on purpose: every input this engine covers is a batch table, so there is no streaming operator."""
