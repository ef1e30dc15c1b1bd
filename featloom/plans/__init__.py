"""Feature engineering, feature store, registry, quality, drift and serving plans."""
