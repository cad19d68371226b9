"""Table access, schemas, sinks, and the views that bind operators to the driver's tables."""
