"""Readers and writers: driver tables, manifests, document files, reports."""
