"""Shuffles and their gates against plain loops over the same panel."""

import numpy as np
import pandas as pd

from loomspan import catalog
from loomspan.plans import shuffles
from loomspan.plans.base import run_sql

SF = "/root/testdata/sf0.001"


def _mix(key, rep):
    u = (key + rep * 15485863) % shuffles.PRIME
    return u * u % shuffles.PRIME * u % shuffles.PRIME


def _plain(panel, strategy, rep):
    y = panel.set_index(["asset_id", "k"])["y"].to_dict()
    drawn = {}
    if strategy == "date_axis":
        dates = sorted({k for _, k in y}, key=lambda k: (_mix(k * 104729, rep), k))
        after = dict(zip(dates, [*dates[1:], dates[0]], strict=True))
        assert all(a != b for a, b in after.items())
        drawn = {(a, k): y[a, after[k]] for a, k in y if (a, after[k]) in y}
    else:
        at = 0 if strategy == "within_asset_time" else 1
        for one in {key[at] for key in y}:
            keys = sorted(key for key in y if key[at] == one)
            for to, origin in zip(keys, sorted(keys, key=lambda key: (_mix(key[0] * 7919 + key[1] * 104729, rep), key[1 - at])), strict=True):
                drawn[to] = y[origin]
    rows = panel.assign(v=[drawn.get((a, k), np.nan) for a, k in zip(panel["asset_id"], panel["k"], strict=True)]).dropna(subset=["v"])
    found = []
    for _, g in rows.groupby("k"):
        z = g["v"] - g.groupby("board")["v"].transform("mean")
        rs, rz = g["s"].rank(), z.rank()
        if len(g) >= 3 and rs.std() > 0 and rz.std() > 0:
            found.append(np.corrcoef(rs, rz)[0, 1])
    return np.mean(found), len(found)


def test_shuffles_and_gates(spark):
    panel = run_sql(spark, SF, shuffles._PANEL).toPandas()
    got = catalog.QUERIES["repeated_time_shuffle"](spark, SF).toPandas()
    assert len(got) == 3 * shuffles.REPETITIONS
    for strategy in ("within_asset_time", "within_date_cross_section", "date_axis"):
        for rep in (1, 17):
            mean, days = _plain(panel, strategy, rep)
            row = got[(got["strategy"] == strategy) & (got["rep"] == rep)].iloc[0]
            assert abs(row["mean_ic"] - mean) < 2e-6 and row["days"] == days
    gate = catalog.QUERIES["permutation_null_gate"](spark, SF).toPandas().set_index("strategy")
    for strategy, g in got.groupby("strategy"):
        low, high = np.quantile(g["mean_ic"], [0.025, 0.975])
        assert abs(gate.loc[strategy, "lower_bound"] - low) < 3e-6 and abs(gate.loc[strategy, "upper_bound"] - high) < 3e-6
        assert gate.loc[strategy, "contains_zero"] == (low <= 0 <= high)


def test_unclipped_shadow_state(spark):
    rows = run_sql(spark, SF, "SELECT asset_id, board, k, ret FROM supr WHERE ret IS NOT NULL").toPandas().sort_values(["asset_id", "k"])
    now, raw, keep = rows["k"].max(), {}, {}
    for (asset, board), g in rows.groupby(["asset_id", "board"]):
        w = 0.5 ** (np.arange(len(g))[::-1] / shuffles.HALF_LIFE)
        keep[asset] = board, w.sum() ** 2 / (w**2).sum()
        raw[asset] = (w * g["ret"].to_numpy() ** 2).sum() / w.sum() if len(g) >= shuffles.LEAST and g["k"].max() == now else np.nan
    boards = pd.Series({a: b for a, (b, _) in keep.items()})
    means = pd.Series(raw).groupby(boards).mean()
    got = catalog.QUERIES["unclipped_shadow_state"](spark, SF).toPandas().set_index("asset_id")["variance"]
    assert set(got.index) == set(raw)
    for asset, (board, size) in keep.items():
        share = shuffles.SHRINK / (shuffles.SHRINK + size)
        want = (1 - share) * raw[asset] + share * means[board]
        assert (np.isnan(want) and np.isnan(got[asset])) or abs(got[asset] - want) < 1e-6 * max(1, want)
