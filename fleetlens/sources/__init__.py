"""Reading, storing and keeping snapshots."""
