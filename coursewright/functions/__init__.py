"""coursewright.functions."""
