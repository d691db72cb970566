"""Numerics that have no column form: run on executors, one group or batch at a time."""

from __future__ import annotations

from ..formula.values import Failed
from ..functions.finance import PROBES, root


def roots(flows, times, guess: float = 0.1):
    """For each row of flows (zero where there is none) at its times the rate at which its value is 0; NaN if none is found.

    As ``root``, for many rows at once: the lowest bracket between probes, halved together; rows without a bracket go by ``root``.
    """
    import numpy as np

    value = lambda rate: (flows / (1 + rate)[:, None] ** times).sum(1)
    probes = np.array(sorted({*PROBES, guess}))
    with np.errstate(all="ignore"):
        known = np.stack([value(np.full(len(flows), p)) for p in probes], 1)
        low, high = probes[:-1], probes[1:]
        span = np.isfinite(known[:, :-1]) & np.isfinite(known[:, 1:]) & ((known[:, :-1] < 0) != (known[:, 1:] < 0))
        best = span.argmax(1)
        out = np.full(len(flows), np.nan)
        ok = span.any(1)
        a, b, below = low[best].copy(), high[best].copy(), np.take_along_axis(known, best[:, None], 1)[:, 0] < 0
        for _ in range(200):
            mid = (a + b) / 2
            left = (value(mid) < 0) == below
            a, b = np.where(left, mid, a), np.where(left, b, mid)
            if (b - a <= 1e-16 * np.maximum(1, abs(mid))).all():
                break
        out[ok] = ((a + b) / 2)[ok]
    for i in np.flatnonzero(~ok):
        try:
            out[i] = root(lambda r, i=i: float((flows[i] / (1 + r) ** times[i]).sum()), guess)
        except Failed:
            pass
    return out


def rates(frames):
    """IRR and XIRR of customers' flows, many to a batch; ``flows`` are (k, v, days) in order. left_over is the value at IRR.
    Flows of one sign have no rate."""
    import numpy as np
    import pandas as pd

    for big in frames:
        for at in range(0, len(big), 2000):
            pdf = big.iloc[at : at + 2000]
            rows = [[(x["v"], x["days"]) for x in f] for f in pdf["flows"]]
            width = max(map(len, rows), default=1)
            v = np.array([[x for x, _ in r] + [0.0] * (width - len(r)) for r in rows])
            days = np.array([[d for _, d in r] + [0] * (width - len(r)) for r in rows]) / 365
            periods = np.broadcast_to(np.arange(float(width)), v.shape)
            mixed = (v > 0).any(1) & (v < 0).any(1)
            irr, xirr = np.full(len(v), np.nan), np.full(len(v), np.nan)
            irr[mixed], xirr[mixed] = roots(v[mixed], periods[mixed]), roots(v[mixed], days[mixed])
            left = (v / (1 + irr)[:, None] ** periods).sum(1).round(4)
            yield pd.DataFrame({"o_custkey": pdf["o_custkey"].to_numpy(), "irr": irr, "xirr": xirr, "left_over": left}).astype(object).where(lambda d: d.notna(), None)
