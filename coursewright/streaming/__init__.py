"""coursewright.streaming."""
