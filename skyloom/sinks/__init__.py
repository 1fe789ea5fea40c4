"""Writers: subtitles, telemetry JSON, meshes, rasters, exports, reports."""
