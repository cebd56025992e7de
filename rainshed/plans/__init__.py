"""The jobs a user runs: storm comparison, water years, cube builds, storm maps."""
