"""Column expressions: labels, value text, paths, geometry and raster arithmetic."""

from layerscan.functions.crs import crs_label, crs_units, wkt_authority_code, wkt_label, wkt_name
from layerscan.functions.geometry import geometry_name, layer_geometry_type
from layerscan.functions.paths import (
    FORMATS,
    RASTER_EXTENSIONS,
    basename,
    extension,
    is_hidden,
    is_inside_container,
    path_format,
    stem,
    trim_separators,
    type_label,
    unsupported_message,
)
from layerscan.functions.raster import cell_size, raster_extent
from layerscan.functions.text import (
    cell_text,
    format_extent,
    highlight_spans,
    human_size,
    render_value,
)
from layerscan.functions.types import field_type_name

__all__ = [
    "FORMATS",
    "RASTER_EXTENSIONS",
    "basename",
    "cell_size",
    "cell_text",
    "crs_label",
    "crs_units",
    "extension",
    "field_type_name",
    "format_extent",
    "geometry_name",
    "highlight_spans",
    "human_size",
    "is_hidden",
    "is_inside_container",
    "layer_geometry_type",
    "path_format",
    "raster_extent",
    "render_value",
    "stem",
    "trim_separators",
    "type_label",
    "unsupported_message",
    "wkt_authority_code",
    "wkt_label",
    "wkt_name",
]
