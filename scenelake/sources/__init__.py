"""Readers: assets, sidecars, cameras, backgrounds, index buffers, datasets, configuration."""
