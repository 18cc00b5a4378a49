"""Readers, base views, key listings, manifests and sinks."""
