"""coursewright.operators."""
