"""Manifests, file-name metadata, GeoJSON, the cube catalogue and sinks."""
