"""folioscope functions."""
