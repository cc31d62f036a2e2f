"""Sources and sinks: manifests, listings, JSON, graph files, masters, ontologies, and the versioned evidence store."""
