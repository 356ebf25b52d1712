"""folioscope plans."""
