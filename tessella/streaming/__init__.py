"""Event streams and state machines."""
