"""The dense solve of one group, from its co-moments or from its triangular factor.

Both take terms in order and give an effect that several terms could carry to the
first of them; a term that can't be identified gets the coefficient 0 and a
verdict, CONSTANT or COLLINEAR.
"""

from __future__ import annotations

import numpy as np

#: Least pivot of the equilibrated matrix, a share of variance.
RANK_EPS = 1e-12
#: Least diagonal of the factor against the column's norm, a share of length.
QR_RANK_EPS = 1e-9
EPS = 2.0**-52


def nothing(code: str, p: int) -> dict:
    return {"failure": code, "intercept": None, "coef": None, "status": None, "df": None, "r2": None, "r2_status": None, "resid_sd": None, "is_bound": False, "cond": None, "pinned": None}


def solve_moments(n: int, mean: np.ndarray, c: np.ndarray) -> dict:
    """mean: of the terms and then the response; c: their centred sums of products, exactly 0 for a column that doesn't vary."""
    p = len(mean) - 1
    if n == 0:
        return nothing("NOT_FINITE", p)
    sxx, sxy, cyy, my = c[:p, :p], c[:p, p], float(c[p, p]), float(mean[p])
    if not np.isfinite(np.append(np.diag(sxx), sxy)).all():
        return nothing("COLUMN_OVERFLOW", p)
    if not np.isfinite(cyy):
        return nothing("RESPONSE_OVERFLOW", p)
    with np.errstate(all="ignore"):
        scale = np.sqrt(np.maximum(np.diag(sxx), 0.0))
        by = np.where(scale > 0, scale, 1.0)
        a = np.column_stack([sxx / by[:, None] / by, sxy / by])
        a[scale == 0, :], a[:, :p][:, scale == 0] = 0.0, 0.0
        status, coef, pivots, kept = ["COLLINEAR"] * p, np.zeros(p), [], []
        for col in range(p):
            rank = len(kept)
            if rank == p:
                break
            best = rank + int(np.argmax(np.abs(a[rank:, col])))
            if scale[col] == 0:
                status[col] = "CONSTANT"
                continue
            if not abs(a[best, col]) > RANK_EPS:
                continue
            a[[rank, best]] = a[[best, rank]]
            pivots.append(abs(float(a[rank, col])))
            a[rank] /= a[rank, col]
            others = np.arange(p) != rank
            a[others] -= np.outer(a[others, col], a[rank])
            kept.append(col)
            status[col] = "FITTED"
        coef[kept] = a[: len(kept), p] / by[kept]
        intercept = my - float(coef @ mean[:p])
    if not np.isfinite(np.append(coef, intercept)).all():
        return nothing("NOT_FINITE", p)
    df = n - len(kept) - 1
    out = {"failure": None, "intercept": intercept, "coef": coef.tolist(), "status": status, "df": df, "r2": None, "r2_status": "OK", "resid_sd": None, "is_bound": False, "cond": max(pivots) / min(pivots) if pivots else 1.0, "pinned": p - len(kept)}
    if not cyy > 0:
        return out | {"r2_status": "FLAT_Y"}
    sse = cyy - float(coef @ sxy)
    if sse < -1e-9 * cyy:
        return out | {"r2_status": "LOST"}
    sse = max(sse, 0.0)
    out["r2"] = max(0.0, 1.0 - sse / cyy)
    floor = abs(my) * EPS * np.sqrt(n * cyy) + EPS * cyy
    out["is_bound"] = bool(sse < floor)
    if df > 0:
        out["resid_sd"] = float(np.sqrt(max(sse, floor) / df))
    return out


def solve_factor(n: int, r: np.ndarray, norm: np.ndarray, lo: np.ndarray, hi: np.ndarray, cyy: float) -> dict:
    """r: triangular factor of (1, terms, response); norm: lengths of the columns of (1, terms); lo, hi: least and greatest of each term."""
    m = r.shape[0] - 1
    p = m - 1
    with np.errstate(over="ignore"):
        rss = float(r[m, m] * r[m, m])
    if n == 0 or not np.isfinite(r).all():
        return nothing("NOT_FINITE" if n == 0 or not np.isfinite(r[:, :m]).all() else "RESPONSE_OVERFLOW", p)
    if not np.isfinite(cyy) or not np.isfinite(rss):
        return nothing("RESPONSE_OVERFLOW", p)
    rel = np.abs(np.diag(r)[:m]) / np.where(norm > 0, norm, 1.0)
    keep = rel > QR_RANK_EPS
    keep[0] = True
    kept = np.flatnonzero(keep)
    with np.errstate(all="ignore"):
        if len(kept) == m:
            top, right = r[:m, :m], r[:m, m]
        else:
            again = np.linalg.qr(r[:m][:, [*kept, m]], mode="r")
            k = len(kept)
            top, right = again[:k, :k], again[:k, k]
            rss += float((again[k:, k] ** 2).sum())
        beta = np.zeros(m)
        part = np.zeros(len(kept))
        for i in range(len(kept) - 1, -1, -1):
            part[i] = (right[i] - top[i, i + 1 :] @ part[i + 1 :]) / top[i, i]
        beta[kept] = part
    if not np.isfinite(beta).all():
        return nothing("NOT_FINITE", p)
    status = ["FITTED" if keep[j + 1] else "CONSTANT" if lo[j] == hi[j] else "COLLINEAR" for j in range(p)]
    df = n - len(kept)
    flat = not cyy > 0
    return {
        "failure": None,
        "intercept": float(beta[0]),
        "coef": beta[1:].tolist(),
        "status": status,
        "df": df,
        "r2": None if flat else max(0.0, 1.0 - rss / cyy),
        "r2_status": "FLAT_Y" if flat else "OK",
        "resid_sd": float(np.sqrt(rss / df)) if df > 0 else None,
        "is_bound": False,
        "cond": float(rel.max() / rel[kept].min()),
        "pinned": m - len(kept),
    }
