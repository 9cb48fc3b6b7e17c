"""Readers, writers and the CRM views derived from the driver's tables."""
