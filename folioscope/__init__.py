"""folioscope: document analytics and evidence retrieval as DataFrame transformations."""
