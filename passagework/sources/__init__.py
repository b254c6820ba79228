"""Readers that turn files and texts into typed blocks, CSV in and out, and the table store."""
