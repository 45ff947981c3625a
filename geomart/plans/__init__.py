"""Registered queries. Importing this package fills the registry."""

from geomart.plans import series_marts  # noqa: F401
from geomart.plans.registry import ORACLE, QUERIES  # noqa: F401
from geomart.plans import spatial_marts  # noqa: F401,E402
from geomart.plans import table_marts  # noqa: F401,E402
from geomart.plans import area_marts  # noqa: F401,E402
from geomart.plans import landing_marts  # noqa: F401,E402
from geomart.plans import timetable_marts  # noqa: F401,E402
from geomart.plans import shape_marts  # noqa: F401,E402
from geomart.plans import yearly_marts  # noqa: F401,E402
