"""The operators bound to tables: a catalogue of queries with their SQL, and the facade of tools."""
