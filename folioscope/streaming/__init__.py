"""folioscope streaming."""
