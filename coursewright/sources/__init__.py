"""coursewright.sources."""
