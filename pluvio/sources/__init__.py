"""Relations read from files: manifests, tiles, forecasts, observations, state."""
