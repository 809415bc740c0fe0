"""Statistical models over row blocks."""
