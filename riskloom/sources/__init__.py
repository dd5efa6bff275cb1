"""Readers, writers and the views that map the sample tables onto the banking entities."""
