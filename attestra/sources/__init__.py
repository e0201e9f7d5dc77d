"""Sources of the event engine."""
