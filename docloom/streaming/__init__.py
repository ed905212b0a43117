"""Streams: files that arrive, opened and read by the same kernels."""
