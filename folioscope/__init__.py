"""folioscope: document-evidence analytics expressed as Spark plans."""
