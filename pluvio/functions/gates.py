"""External gates, schedules, labels and checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLL_MINUTES = (1, 11, 21, 31, 41, 51)
ICONS = {"none": "mdi:weather-cloudy", "light": "mdi:weather-rainy", "moderate": "mdi:weather-pouring", "heavy": "mdi:weather-pouring", "extreme": "mdi:weather-lightning-rainy"}
STYLES = ("voyager", "osm_standard", "osm_dark", "dark_matter", "esri_imagery")
#: Icons of the sensors while on and off.
SENSOR_ICONS = {"imminent": ("mdi:weather-pouring", "mdi:weather-sunny"), "arrival": ("mdi:clock-alert-outline", "mdi:clock-outline")}
#: Where the tiles of the map styles are (zoom, column, row); the last style has
#: overlays, and row before column.
_ESRI = "https://server.arcgisonline.com/ArcGIS/rest/services/"
TILE_URLS = {
    "voyager": ("https://basemaps.cartocdn.com/rastertiles/voyager/%1$d/%2$d/%3$d.png",),
    "osm_standard": ("https://tile.openstreetmap.org/%1$d/%2$d/%3$d.png",),
    "osm_dark": ("https://tile.openstreetmap.org/%1$d/%2$d/%3$d.png",),
    "dark_matter": ("https://basemaps.cartocdn.com/dark_all/%1$d/%2$d/%3$d.png",),
    "esri_imagery": tuple(f"{_ESRI}{layer}/MapServer/tile/%1$d/%3$d/%2$d" for layer in ("World_Imagery", "Reference/World_Transportation", "Reference/World_Boundaries_and_Places")),
}
OPTION_KEYS = ("latitude", "longitude", "location_name", "lookahead_minutes", "map_style", "forecast_enabled", "satellite_enabled")


def pop_multiplier(pop: Column) -> Column:
    """How many times as many frames a probability of precipitation asks for; unknown: 1."""
    return F.when(pop.isNull(), 1.0).when(pop < 5, 3.0).when(pop < 30, 2.0).otherwise(1.0)


def cloud_multiplier(fraction: Column) -> Column:
    return F.when(fraction.isNull(), 1.0).when(fraction < 0.1, 3.0).otherwise(1.0)


def required_frames(pop: Column, cloud: Column, min_frames: int = 2) -> Column:
    return F.ceil(min_frames * F.greatest(pop_multiplier(pop), cloud_multiplier(cloud))).cast("int")


def intensity_label(value: Column) -> Column:
    return F.when(value <= 0, "none").when(value <= 0.2, "light").when(value <= 0.45, "moderate").when(value <= 0.75, "heavy").otherwise("extreme")


def icon(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])[label]


def next_poll(epoch: Column) -> Column:
    """The next second at minute 1, 11, 21, ... of an hour, strictly after ``epoch`` (seconds)."""
    return (F.floor((epoch - 60) / 600) * 600 + 660).cast("long")


def poll_delay(epoch: Column) -> Column:
    return F.greatest(next_poll(epoch) - epoch, F.lit(10)).cast("long")


def pacing_delay(limit: Column, used: Column, window: Column) -> Column:
    """Seconds between requests that a budget of ``limit`` in ``window`` seconds leaves."""
    left = F.greatest(limit - used, F.lit(0))
    return F.when((limit.isNull()) | (limit == 0), 0.0).when(used / limit < 0.8, 0.0).when(left == 0, window.cast("double")).otherwise(window / left)


def retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def backoff(attempt: Column, base: float = 5.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def retry_delay(status: Column, attempt: Column, retry_after: Column, base: float = 1.0, most: int = 3) -> Column:
    """Seconds until the next try of a request, null where there is none; ``retry_after`` is the
    header of that name, which counts for status 429 if it is a number."""
    own = F.when(status == 429, retry_after.try_cast("double"))
    return F.when(retryable(status) & (attempt < most), F.coalesce(own, F.lit(base) * F.pow(F.lit(2.0), attempt)))


def poll_backoff(failures: Column, base: float = 5.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait after so many failures in a row, null where the poll gives up: as soon as
    the wait would reach ``most``."""
    wait = F.lit(base) * F.pow(F.lit(factor), failures - 1)
    return F.when(wait < most, wait)


def gate_if(enabled: Column, multiplier: Column) -> Column:
    """A gate's multiplier, 1 where it is switched off."""
    return F.when(F.coalesce(enabled, F.lit(False)), multiplier).otherwise(1.0)


def merged_options(stored: Column, given: Column) -> dict[str, Column]:
    """Each editable key: the given value, else the stored one. Both are structs."""
    return {k: F.coalesce(given[k], stored[k]) for k in OPTION_KEYS}


def known_style(style: Column) -> Column:
    """``style``, an error if it is none of STYLES."""
    return F.when(style.isin(*STYLES), style).otherwise(F.raise_error(F.concat(F.lit("unknown map style: "), F.coalesce(style, F.lit("null")))).cast("string"))


def tile_urls(style: Column, zoom: Column, x: Column, y: Column) -> Column:
    """Where the layers of a tile are, from the bottom up; null for an unknown style."""
    urls = F.lit(None).cast("array<string>")
    for name, layers in TILE_URLS.items():
        urls = F.when(style == name, F.array(*[F.format_string(u, zoom, x, y) for u in layers])).otherwise(urls)
    return urls


def sensor_icon(sensor: str, on: Column) -> Column:
    lit, dark = SENSOR_ICONS[sensor]
    return F.when(on, lit).otherwise(dark)


def short_name(name: Column, most: int = 16) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)


def frame_label(name: Column, ts: Column, radius_km: Column) -> Column:
    when = F.date_format(ts, "dd/MM/yy  HH:mm")
    return F.concat_ws("  ", F.when(F.length(F.trim(name)) > 0, short_name(F.trim(name))), F.concat(when, F.lit(" UTC")), F.concat(radius_km.cast("int").cast("string"), F.lit("km")))


def device_name(name: Column, lat: Column, lon: Column) -> Column:
    place = F.format_string("(%.2f, %.2f)", lat, lon)
    return F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) > 0, F.trim(name)).otherwise(place)


def printed(value: Column, places: int) -> Column:
    """``value`` with so many decimal places, as C and Python print it: by its exact binary value, halves to even.
    ``format_string`` goes by the shortest decimal and takes halves up."""
    return F.call_function("format_number", value, F.lit(f"0.{'0' * places}" if places else "0"))


def config_errors(lat: Column, lon: Column, lookahead: Column, name: Column, style: Column) -> Column:
    """A map from field to error code; empty where all is well."""
    every = F.create_map(
        F.lit("latitude"), F.when(~lat.between(-90, 90), "invalid_latitude"),
        F.lit("longitude"), F.when(~lon.between(-180, 180), "invalid_longitude"),
        F.lit("lookahead_minutes"), F.when(~lookahead.between(20, 60), "invalid_lookahead"),
        F.lit("location_name"), F.when(F.length(name) > 16, "location_name_too_long"),
        F.lit("map_style"), F.when(~style.isin(*STYLES), "invalid_map_style"),
    )
    return F.map_filter(every, lambda _, v: v.isNotNull())
