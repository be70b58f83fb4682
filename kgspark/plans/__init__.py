"""Graph type, checkpoints and pattern plans."""
