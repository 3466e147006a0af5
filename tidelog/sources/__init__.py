"""Readers, ingest steps, inventories and sinks."""
