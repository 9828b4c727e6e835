"""Count windows over streams and their state."""
