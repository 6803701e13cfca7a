"""Part of the resource query engine."""
