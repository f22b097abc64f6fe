"""GeoJSON, stored objects, workspaces and layers."""
