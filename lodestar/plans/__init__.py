"""Query registry: named plans and their SQL twins."""
