"""References as a stream: rows answered as they come, and answers kept for a while."""
