"""Hand-written incident rows."""

import datetime as dt

from kerbwise.functions.geo import with_cell
from kerbwise.schema import INCIDENT_CSV

BASE = {
    "accident_id": "ACC_000001",
    "city": "Pune",
    "state": "Maharashtra",
    "latitude": 18.5,
    "longitude": 73.8,
    "accident_datetime": dt.datetime(2021, 3, 18, 9, 30, 5),
    "date": dt.date(2021, 3, 18),
    "time": "09:30:05",
    "hour": 9,
    "day_of_week": 3,
    "month": 3,
    "year": 2021,
    "severity": 2,
    "severity_label": "Serious",
    "vehicle_type": "Car",
    "road_type": "Highway",
    "weather": "Clear",
    "casualties": 1,
    "fatalities": 0,
    "injured": 1,
}


def make(spark, *changes, cell=True):
    """One row per dict of changes; ids count up unless given."""
    rows = []
    for i, change in enumerate(changes):
        row = {**BASE, "accident_id": f"ACC_{i + 1:06d}", **change}
        rows.append(tuple(row[name] for name in INCIDENT_CSV.fieldNames()))
    df = spark.createDataFrame(rows, INCIDENT_CSV)
    return with_cell(df) if cell else df
