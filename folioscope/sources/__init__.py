"""folioscope sources."""
