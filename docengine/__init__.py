"""docengine: document analytics as Spark plans."""
