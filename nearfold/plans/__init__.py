"""Configuration, schemas and the shared-storage helper that longer plans are cut with."""
