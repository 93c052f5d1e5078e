"""Readers that turn fact tables into panels, and sinks."""
