"""Stream and batch outputs."""
