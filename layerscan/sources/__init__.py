"""Where datasets come from: file trees, containers, shapefiles and rasters."""
