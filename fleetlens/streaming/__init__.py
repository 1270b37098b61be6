"""Event-time triggers."""
