"""Files, registries and reports."""
