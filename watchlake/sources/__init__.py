"""Reading raw exports and events, reading and writing the stored tables."""
