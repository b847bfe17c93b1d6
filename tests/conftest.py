import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from liftfield.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(n, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=n)


def noise(*parts):
    """Reproducible pseudo-noise in [-1, 1)."""
    import hashlib

    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(h[:8], 16) / 2**31 - 1.0


def panel_rows(n_t=10, n_h=6, n_pre=40, n_post=21, lift=0.0, base=1000.0, sd=0.05, test="t"):
    rows = []
    for g in range(n_t + n_h):
        cell = "treatment" if g < n_t else "holdout"
        level = base * (1 + 0.2 * noise("g", g))
        for d in range(n_pre + n_post):
            season = 1 + 0.1 * noise("d", d)
            v = level * season * (1 + sd * noise(g, d))
            post = d >= n_pre
            if post and cell == "treatment":
                v *= 1 + lift
            rows.append((test, f"g{g:02d}", cell, day(d), v, int(v // 100), "post" if post else "pre"))
    return rows


PANEL_SCHEMA = "test_id string, geo string, cell string, date date, revenue double, orders bigint, period string"


@pytest.fixture(scope="session")
def make_panel(spark):
    def make(**kw):
        return spark.createDataFrame(panel_rows(**kw), PANEL_SCHEMA)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
