"""folioscope operators."""
