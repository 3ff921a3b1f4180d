"""Small hand-made flows tables."""

import datetime as dt

from tidewatch.schema import FLOWS_DDL

START = dt.datetime(2024, 1, 1)
NAMES = [part.split()[0] for part in FLOWS_DDL.split(", ")]
DEFAULTS = {
    "src_ip": "10.0.0.1", "dst_ip": "192.168.0.1", "src_port": 40000, "dst_port": 0, "protocol": "TCP",
    "bytes_sent": 0, "bytes_received": 0, "packets": 1, "duration": 0.0, "flags": "", "action": "",
    "status_code": None, "direction": "unknown", "domain": "",
}


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def row(seconds, **values):
    return {"ts": at(seconds), **DEFAULTS, **values}


def flows(spark, rows):
    data = [tuple({"event_id": i, **r}[n] for n in NAMES) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, FLOWS_DDL)


def by(df, *keys):
    """Rows as dicts under their key."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}
