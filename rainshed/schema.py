"""Table schemas, variable lists and other fixed values of the six products."""

from __future__ import annotations

from pyspark.sql import types as T

# Variable names of each product.
HRRR_PARAMETERS = {
    "TMP": "surface",
    "RH": "2 m above ground",
    "WIND": "10 m above ground",
    "APCP": "surface:0-1 hour acc fcst",
    "DSWRF": "surface",
    "DLWRF": "surface",
}
HRRR_COLUMNS = {
    "TMP": ["t"], "RH": ["r2"], "WIND": ["si10", "max_10si"], "APCP": ["tp"], "DSWRF": ["sdswrf"], "DLWRF": ["sdlwrf"],
}
HRRR_INSTANT = ["t", "r2", "si10", "sdswrf", "sdlwrf"]
PRISM_VARIABLES = ["tmean", "tmax", "tmin", "ppt", "vpdmax", "vpdmin", "tdmean"]
WRF_VARIABLES = ["T2", "RAINC", "RAINNC", "U10", "V10", "LWDNB", "SWDNB", "Q2", "PSFC"]
PNNL_VARIABLES = ["GLW", "PREC_ACC_NC", "T2", "Q2", "SWDOWN", "U10", "V10"]
PNNL_SCENARIOS = ["historical", "HadGEM2_ES", "CanESM2", "CESM1_CAM5", "GFDL_ESM2M", "MPI_ESM_MR"]
ORNL_DEFAULTS = ["prcp", "tmax", "tmin", "wind", "rhum", "srad", "lrad"]
ORNL_VARIABLES = ORNL_DEFAULTS + [
    "qair", "vp", "vpd", "pres", "runoff", "runoffs", "runoffb", "swe", "evap", "pet", "soilm",
    "PRMS_runoff", "PRMS_runoffs", "PRMS_runoffb", "PRMS_swe", "PRMS_evap", "PRMS_pet", "PRMS_soilm",
]
SNOTEL_VARIABLES = [
    "SNOWDEPTH", "SWE", "PRECIPITATION", "ACCUMULATED PRECIPITATION", "AIR TEMP", "AVG AIR TEMP", "MAX AIR TEMP",
]

# Choices of the ORNL archive.
ORNL_ROOT = "https://hydrosource2.ornl.gov/files/SWA9505V3"
ORNL_REFERENCES = ["DaymetV4", "Livneh"]
ORNL_HYDRO_MODELS = ["VIC4"]
ORNL_DOWNSCALING = ["DBCCA", "RegCM"]
ORNL_SCENARIOS = ["ssp126", "ssp245", "ssp370", "ssp585"]
ORNL_ENSEMBLES = {
    "ACCESS-CM2": "r1i1p1f1",
    "BCC-CSM2-MR": "r1i1p1f1",
    "CNRM-ESM2-1": "r1i1p1f2",
    "EC-Earth3": "r1i1p1f1",
    "MPI-ESM1-2-HR": "r1i1p1f1",
    "MRI-ESM2-0": "r1i1p1f1",
    "NorESM2-MM": "r1i1p1f1",
}
ORNL_REFERENCE_YEARS = (1950, 2018)
ORNL_GCM_YEARS = (1980, 2099)

# Choices of the WRF, PRISM and SNOTEL archives.
WRF_TIER_PREFIX = {1: "wrfout", 2: "auxhist"}
WRF_DOMAINS = [1, 2, 3, 4]
PRISM_REGIONS = ["us", "ak", "hi", "pr"]
PRISM_RESOLUTIONS = ["4km", "800m", "400m"]
PRISM_FORMATS = ["nc", "bil", "asc", "geotiff"]
FREQUENCIES = ["daily", "monthly", "annual"]
STATION_FREQUENCIES = ["hourly", "daily"]
# dates in PRISM names and requests, by frequency
PRISM_DATE_FORMAT = {"daily": "yyyyMMdd", "monthly": "yyyyMM", "annual": "yyyy"}

# Storm windows, first and last day.
STORMS = [
    ("1990", "1990-11-03", "1990-11-17"),
    ("1995", "1995-11-22", "1995-12-06"),
    ("2003", "2003-10-14", "2003-10-28"),
    ("2006", "2006-10-31", "2006-11-13"),
    ("2011", "2011-01-01", "2011-02-01"),
    ("2021", "2021-11-10", "2021-11-17"),
]


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


def _doubles(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, T.DoubleType()) for name in names]


_NTZ, _INT, _STR, _DATE, _DBL = T.TimestampNTZType(), T.IntegerType(), T.StringType(), T.DateType(), T.DoubleType()

PRISM = _table(("time", _DATE), *_doubles("lat", "lon", *PRISM_VARIABLES), ("frequency", _STR), ("resolution", _STR))
ORNL = _table(("time", _DATE), *_doubles("lat", "lon", *ORNL_VARIABLES))
WRF = _table(("time", _NTZ), ("y", _INT), ("x", _INT), *_doubles(*WRF_VARIABLES))
PNNL = _table(("scenario", _STR), ("time", _NTZ), ("y", _INT), ("x", _INT), *_doubles(*PNNL_VARIABLES))
HRRR_RAW = _table(
    ("time", _NTZ), ("step_h", _INT), ("y", _INT), ("x", _INT),
    *_doubles("lon360", "lat", "t", "r2", "si10", "max_10si", "tp", "sdswrf", "sdlwrf"),
)
SNOTEL = _table(
    ("time", _NTZ), ("site", _STR), ("site_name", _STR),
    *_doubles("lat", "lon", "elevation_ft", *SNOTEL_VARIABLES),
)
CELLS = _table(("product", _STR), ("y", _INT), ("x", _INT), *_doubles("lat", "lon", "hgt"), ("landmask", _INT))
DEM = _table(("band", _INT), ("iy", _INT), ("ix", _INT), *_doubles("x", "y", "elevation"))
STATIONS = _table(("id", _STR), ("name", _STR), ("datasource", _STR), *_doubles("lon", "lat", "elev_ft"))
EDGES = _table(("feature", _INT), *_doubles("x1", "y1", "x2", "y2"))
WINDOWS = _table(("event", _STR), ("start_day", _DATE), ("end_day", _DATE))
