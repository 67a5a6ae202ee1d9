"""Keyed state: pure kernels shared by batch and Structured Streaming."""
