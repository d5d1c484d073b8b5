"""Coordinate systems: from the keys of a GeoTIFF to well-known text."""

from __future__ import annotations

# Numbers of GeoTIFF keys.
MODEL, GEOGRAPHIC, GEOGRAPHIC_NAME, LINEAR_GEO, ELLIPSOID = 1024, 2048, 2049, 2052, 2056
MAJOR, MINOR, FLATTENING, MERIDIAN = 2057, 2058, 2059, 2061
PROJECTED, PROJECTED_NAME, METHOD, LINEAR = 3072, 3073, 3075, 3076
USER = 32767
# Ellipsoids (name, half the long axis, inverse flattening, code) by code of the EPSG list.
ELLIPSOIDS = {7030: ("WGS 84", 6378137.0, 298.257223563), 7019: ("GRS 1980", 6378137.0, 298.257222101), 7043: ("WGS 72", 6378135.0, 298.26)}
# Geographic systems (name, datum, code of the datum, code of the ellipsoid) of the EPSG list.
GEOGRAPHICS = {4326: ("WGS 84", "WGS_1984", 6326, 7030), 4269: ("NAD83", "North_American_Datum_1983", 6269, 7019), 4258: ("ETRS89", "European_Terrestrial_Reference_System_1989", 6258, 7019), 4322: ("WGS 72", "WGS_1972", 6322, 7043)}
# Linear units of the EPSG list, in metres.
UNITS = {9001: ("metre", 1.0), 9002: ("foot", 0.3048), 9003: ("US survey foot", 0.304800609601219)}
# Methods of projection (name, and the parameters' names with the keys that may hold them).
_LAT, _LONG = (3081, 3085, 3089), (3080, 3084, 3088, 3095)
_EAST, _NORTH, _SCALE = (3082, 3086), (3083, 3087), (3092, 3093)
METHODS = {
    1: ("Transverse_Mercator", {"latitude_of_origin": _LAT, "central_meridian": _LONG, "scale_factor": _SCALE, "false_easting": _EAST, "false_northing": _NORTH}),
    7: ("Mercator_1SP", {"central_meridian": _LONG, "scale_factor": _SCALE, "false_easting": _EAST, "false_northing": _NORTH}),
    8: ("Lambert_Conformal_Conic_2SP", {"standard_parallel_1": (3078,), "standard_parallel_2": (3079,), "latitude_of_origin": _LAT, "central_meridian": _LONG, "false_easting": _EAST, "false_northing": _NORTH}),
    9: ("Lambert_Conformal_Conic_1SP", {"latitude_of_origin": _LAT, "central_meridian": _LONG, "scale_factor": _SCALE, "false_easting": _EAST, "false_northing": _NORTH}),
    10: ("Lambert_Azimuthal_Equal_Area", {"latitude_of_center": _LAT, "longitude_of_center": _LONG, "false_easting": _EAST, "false_northing": _NORTH}),
    11: ("Albers_Conic_Equal_Area", {"standard_parallel_1": (3078,), "standard_parallel_2": (3079,), "latitude_of_center": _LAT, "longitude_of_center": _LONG, "false_easting": _EAST, "false_northing": _NORTH}),
    15: ("Polar_Stereographic", {"latitude_of_origin": _LAT, "central_meridian": _LONG, "scale_factor": _SCALE, "false_easting": _EAST, "false_northing": _NORTH}),
    17: ("Equirectangular", {"standard_parallel_1": (3078,), "central_meridian": _LONG, "false_easting": _EAST, "false_northing": _NORTH}),
    24: ("Sinusoidal", {"longitude_of_center": _LONG, "false_easting": _EAST, "false_northing": _NORTH}),
}


def keys(directory: tuple[int, ...] | None, doubles: tuple[float, ...] | None = None, text: tuple[str, ...] | None = None) -> dict[int, int | float | str]:
    """The values of a directory of keys; numbers and texts stand in tags of their own."""
    out: dict[int, int | float | str] = {}
    for i in range(4, len(directory or ()) - 3, 4):
        key, where, count, value = directory[i : i + 4]
        if where == 0:
            out[key] = value
        elif where == 34736 and doubles and value < len(doubles):
            out[key] = doubles[value]
        elif where == 34737 and text:
            out[key] = text[0][value : value + count].rstrip("|\0")
    return out


def _number(x: float) -> str:
    return f"{x:.15g}"


def _authority(code: int) -> str:
    return f',AUTHORITY["EPSG","{code}"]'


def _geographic(k: dict) -> str:
    code = k.get(GEOGRAPHIC, USER)
    if code != USER and code not in GEOGRAPHICS:
        return f'GEOGCS["unknown"{_authority(code)}]'
    if code in GEOGRAPHICS:
        name, datum, number, ellipsoid = GEOGRAPHICS[code]
        ends = _authority(number), _authority(code)
    else:
        name, datum, ellipsoid, ends = str(k.get(GEOGRAPHIC_NAME, "unknown")), "unknown", k.get(ELLIPSOID, USER), ("", "")
    if ellipsoid in ELLIPSOIDS:
        what, major, inverse = ELLIPSOIDS[ellipsoid]
        number = _authority(ellipsoid)
    else:
        what, major, number = "unknown", float(k.get(MAJOR, 6378137.0)), ""
        minor = float(k.get(MINOR, major))
        inverse = float(k[FLATTENING]) if FLATTENING in k else major / (major - minor) if minor != major else 0.0
    spheroid = f'SPHEROID["{what}",{_number(major)},{_number(inverse)}{number}]'
    return f'GEOGCS["{name}",DATUM["{datum}",{spheroid}{ends[0]}],PRIMEM["{"Greenwich" if not k.get(MERIDIAN) else "unknown"}",{_number(float(k.get(MERIDIAN, 0)))}],UNIT["degree",0.0174532925199433]{ends[1]}]'


def _projected(name: str, k: dict, method: str, values: dict[str, float], code: int | None) -> str:
    unit, metres = UNITS.get(k.get(LINEAR, 9001), UNITS[9001])
    params = "".join(f',PARAMETER["{p}",{_number(v)}]' for p, v in values.items())
    return f'PROJCS["{name}",{_geographic(k)},PROJECTION["{method}"]{params},UNIT["{unit}",{_number(metres)}]{_authority(code) if code else ""}]'


def wkt(k: dict[int, int | float | str]) -> str | None:
    """Well-known text of what ``keys`` gives; None where a file says nothing.

    Geographic systems and ellipsoids of the tables above and user-defined ones are
    spelled out, and so are projections by METHODS and the UTM zones of WGS 84. Another
    code is named by its authority alone.
    """
    if not k:
        return None
    if k.get(MODEL) != 1:
        return _geographic(k)
    code = k.get(PROJECTED, USER)
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        south, zone = code > 32700, code % 100
        values = {"latitude_of_origin": 0.0, "central_meridian": 6.0 * zone - 183, "scale_factor": 0.9996, "false_easting": 500000.0, "false_northing": 1e7 * south}
        return _projected(f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}", {**k, GEOGRAPHIC: 4326}, METHODS[1][0], values, code)
    name = str(k.get(PROJECTED_NAME, "unknown"))
    if code != USER or k.get(METHOD) not in METHODS:
        return f'PROJCS["{name}"{_authority(code) if code != USER else ""}]'
    method, wanted = METHODS[k[METHOD]]
    values = {p: float(next((k[x] for x in from_ if x in k), 1.0 if p == "scale_factor" else 0.0)) for p, from_ in wanted.items()}
    return _projected(name, k, method, values, None)
