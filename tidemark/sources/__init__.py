"""Storage: file systems, schemas, the manifest, the log store and its formats."""
