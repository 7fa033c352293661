"""Set-oriented operators: each takes frames keyed by document or query and returns a frame."""
