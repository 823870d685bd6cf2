"""Point-in-time feature tables."""
