"""Readers for raw inputs and the idempotent store."""
