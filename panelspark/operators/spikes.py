"""Implausible readings per source: spikes, standstills and impossible values, relative to the source's own behaviour.

Per source: a robust seasonal-trend decomposition of the logarithm. The season is the median by position in the day or
week of what a running median over a whole season leaves; the trend is the running median of the deseasonalised log
over a few readings. The generalised extreme studentised deviate test splits the rest into ordinary readings and
deviates. The ordinary ones give the source's usual move, the mean size of the steps between neighbours; a deviate is a
spike if it is far more usual moves away and the level returns after a few readings. Impossible values and runs of
equal values are checked separately.

All of this goes by counts in narrow bins, a source being one chunk or several: one with more than CHUNK_ROWS readings
is cut along time into chunks of about as many rows, whose counts are added up. Each chunk sees HALO readings of its
neighbours and how far runs of equal values reach beyond it. The bins round a move by at most 1/8,192 of itself, a rest
by at most 1/2,000 of a median move (or of itself).
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import join_dimension, within

#: Readings of one source in one chunk, about.
CHUNK_ROWS = 50_000
#: Readings of a neighbouring chunk that a chunk sees.
HALO = 64
#: Bins in one e-fold of a move; width of the bins of asinh(rest / usual move).
MOVE_BINS, REST_BIN = 4096, 0.001


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Quantile of Student's t by the Cornish-Fisher expansion about the normal one; good to three digits from df = 4 on."""
    z = NormalDist().inv_cdf(p)
    df = np.maximum(df, 1.0)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / df + g2 / df**2 + g3 / df**3


@lru_cache(maxsize=1 << 16)
def gesd_limit(left: int, alpha: float = 0.05) -> float:
    """Limit of the generalised extreme studentised deviate test for the most extreme of `left` values."""
    t = float(t_quantile(1 - alpha / (2 * left), np.array(left - 2.0)))
    return (left - 1) * t / math.sqrt((left - 2 + t * t) * left)


def gesd_bounds(values: np.ndarray, counts: np.ndarray, least_scale: float = 0.0, share: float = 0.5) -> tuple[float, float]:
    """Bounds beyond which values are deviates by the generalised extreme studentised deviate test.

    values: in order, each as often as counted. The value farthest from the mean is removed, mean and deviation (at
    least `least_scale`) are those of what is left, up to `share` of the values; the largest number of removals at
    which the removed value exceeded its limit counts. Equal values go together, by the test of the last of them.
    """
    n = int(counts.sum())
    if n < 8:
        return -math.inf, math.inf
    centre = weighted_median(values, counts)
    v, c = (values - centre).tolist(), counts.tolist()
    left, s1, s2 = n, float(np.dot(v, counts)), float(np.dot(np.square(v), counts))
    lo, hi, kept = 0, len(v) - 1, None
    while lo < hi:
        mean = s1 / left
        down = mean - v[lo] > v[hi] - mean
        x, m = (v[lo], c[lo]) if down else (v[hi], c[hi])
        if n - left + m > n * share:
            break
        k, t1, t2 = left - m + 1, s1 - (m - 1) * x, s2 - (m - 1) * x * x  # when one copy is left
        mean = t1 / k
        scale = max(math.sqrt(max(t2 - k * mean * mean, 0.0) / (k - 1)), least_scale)
        left, s1, s2 = left - m, s1 - m * x, s2 - m * x * x
        lo, hi = (lo + 1, hi) if down else (lo, hi - 1)
        if abs(x - mean) > gesd_limit(k) * scale:
            kept = lo, hi
    return (-math.inf, math.inf) if kept is None else (v[kept[0]] + centre, v[kept[1]] + centre)


def gesd(values: np.ndarray, least_scale: float = 0.0) -> np.ndarray:
    """Mask of the deviates among values."""
    low, high = gesd_bounds(*np.unique(values, return_counts=True), least_scale)
    return (values < low) | (values > high)


def running_median(x: np.ndarray, half: int) -> np.ndarray:
    n = len(x)
    if n <= 2 * half:
        half = max(0, (n - 1) // 2)
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]]) if half else x
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def slots(ts: np.ndarray, gap: float) -> np.ndarray:
    """Slot of the day, or the weekday of readings half a day apart or more."""
    day = 86_400e6
    return (ts % int(day)) // max(int(gap), int(day) // 96) if gap < day / 2 else ts // int(day) % 7


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    up = np.cumsum(counts[order])
    mid = np.searchsorted(up, [(up[-1] - 1) // 2, up[-1] // 2], side="right")
    return float(values[order][mid].mean())


def rest_keys(rest: np.ndarray, move: float) -> np.ndarray:
    return np.rint(np.arcsinh(rest / move) / REST_BIN).astype(np.int64)


def rest_values(keys: np.ndarray, move: float) -> np.ndarray:
    return np.sinh(keys * REST_BIN) * move


def season_half(gap: float, few: int) -> int:
    """Half the readings of a season, as far as a chunk's halo reaches; at least `few`."""
    return max(few, min(HALO - few, int(round(86_400e6 / gap / 2)))) if 0 < gap < 86_400e6 / 2 else few


def season(slot: np.ndarray, keys: np.ndarray, counts: np.ndarray, usual: dict) -> dict:
    """The seasonal shift by slot, from binned departures from the trend over a season; 0 unless it explains something.

    That is, if it shrinks the median size of the departures by a tenth more than medians of noise would.
    """
    n, move, gap = usual["n"], usual["move"], usual["gap"]
    codes, inverse = np.unique(slot, return_inverse=True)
    shift = np.zeros(len(codes))
    if n >= 40 and gap > 0 and len(codes) > 1 and np.median(np.bincount(inverse, counts)) >= 8:
        v = rest_values(keys, move)
        mad = lambda x: weighted_median(np.abs(x - weighted_median(x, counts)), counts)
        medians = np.array([weighted_median(v[inverse == i], counts[inverse == i]) for i in range(len(codes))])
        medians -= np.median(medians)
        by_chance = math.sqrt(max(1 - 1.57 * len(codes) / n, 0.0))
        if mad(v - medians[inverse]) < 0.9 * by_chance * mad(v):
            shift = medians
    return {"slot": codes, "shift": shift}


def bounds(keys: np.ndarray, counts: np.ndarray, usual: dict) -> dict:
    """The bins of the rest beyond which a reading is a deviate."""
    order = np.argsort(keys)
    low, high = gesd_bounds(rest_values(keys[order], usual["move"]), counts[order], 0.5 * usual["move"])
    return {"low": low, "high": high}


class Seen:
    """The log of a chunk's positive values with what it sees of its neighbours; `own` are the chunk's."""

    def __init__(self, log: np.ndarray, ts: np.ndarray, own: slice):
        self.log, self.ts, self.own = log, ts.astype(np.int64), own

    def move_keys(self) -> np.ndarray:
        d = np.abs(np.diff(self.log[max(self.own.start - 1, 0) : self.own.stop]))
        return np.floor(np.log(d[d > 0]) * MOVE_BINS).astype(np.int64)

    def gap_keys(self) -> np.ndarray:
        """Time from one reading to the next in seconds, a day at most."""
        gap = np.diff(self.ts[max(self.own.start - 1, 0) : self.own.stop])
        return np.where(gap > 0, np.clip(np.rint(gap / 1e6), 1, 86_400), 0).astype(np.int64)

    def season_keys(self, usual: dict, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and binned departures from the trend over a season."""
        rest = self.log - running_median(self.log, season_half(usual["gap"], few))
        slot = slots(self.ts, usual["gap"]) if usual["gap"] > 0 else np.zeros(len(self.log), np.int64)
        return slot[self.own], rest_keys(rest[self.own], usual["move"])

    def settled(self, usual: dict) -> np.ndarray:
        """The log without its season."""
        if not np.any(usual["shift"]):
            return self.log
        return self.log - pd.Series(usual["shift"], usual["slot"]).reindex(slots(self.ts, usual["gap"])).fillna(0.0).to_numpy()

    def rest(self, usual: dict, few: int) -> np.ndarray:
        """Binned departures from the trend, of all readings seen."""
        x = self.settled(usual)
        return rest_keys(x - running_median(x, few), usual["move"])

    def deviates(self, usual: dict, few: int) -> np.ndarray:
        v = rest_values(self.rest(usual, few), usual["move"])
        return (v < usual["low"]) | (v > usual["high"])

    def ordinary_moves(self, usual: dict, few: int) -> tuple[float, int]:
        """Sum and number of the moves between neighbours neither of which is a deviate, standing still left out."""
        begin = max(self.own.start - 1, 0)
        calm = ~self.deviates(usual, few)[begin : self.own.stop]
        d = np.abs(np.diff(self.settled(usual)[begin : self.own.stop]))[calm[1:] & calm[:-1]]
        return float(d.sum()), int((d > 0).sum())


def median_move(d: np.ndarray, d_counts: np.ndarray, gap: np.ndarray, gap_counts: np.ndarray, n: int) -> dict:
    move = weighted_median(np.exp((d + 0.5) / MOVE_BINS), d_counts) if len(d) else 0.0
    return {"n": n, "move": move, "gap": 1e6 * weighted_median(gap.astype(float), gap_counts) if len(gap) else 0.0}


def usual_of_whole(seen: Seen, few: int) -> dict:
    """What is usual in a source that is a single chunk; _usual() puts the same together for several."""
    count = lambda k: np.unique(k, return_counts=True)
    usual = median_move(*count(seen.move_keys()), *count(seen.gap_keys()), len(seen.log))
    if usual["move"] <= 0:
        return usual | {"usual": 0.0}
    usual |= season(*seen.season_keys(usual, few), np.ones(len(seen.log), int), usual)
    usual |= bounds(*count(seen.rest(usual, few)), usual)
    total, moves = seen.ordinary_moves(usual, few)
    return usual | {"usual": total / moves if moves else usual["move"]}


def spikes(seen: Seen, usual: dict, far: float, few: int) -> np.ndarray:
    """Mask of the deviates that lie more than far usual moves away from the level around them, for at most few readings."""
    n = len(seen.log)
    out = np.zeros(n, bool)
    move = usual["usual"]
    if usual["n"] < 5 or n < 2 or not move > 0:
        return out
    log = seen.settled(usual)
    rest = np.abs(log - running_median(log, few))
    extreme = seen.deviates(usual, few) & (rest > far / 2 * move)
    if not extreme.any():
        return out
    groups = lambda mask: np.split(np.flatnonzero(mask), np.flatnonzero(np.diff(np.flatnonzero(mask)) > 1) + 1)

    def returns(g: np.ndarray, calm: np.ndarray) -> np.ndarray:
        at = np.searchsorted(calm, g[0])
        before, after = calm[max(0, at - 3) : at], calm[at : at + 3]
        if not len(before) or not len(after) or len(g) > few:
            return np.zeros(len(g), bool)
        lo, hi = float(np.median(log[before])), float(np.median(log[after]))
        off = np.abs(log[g] - (lo + hi) / 2)
        return (off > far * move) & (abs(hi - lo) < off / 2)

    farthest = extreme.copy()
    for g in groups(extreme):  # beside a far reading, those not half as far may be the level around it
        farthest[g] = rest[g] >= rest[g].max() / 2
    level, calm = np.flatnonzero(~farthest), np.flatnonzero(~extreme)
    for g in groups(farthest):
        out[g] = returns(g, level)
    for g in groups(extreme):  # or bad readings of another size: all of them against the level around them all
        out[g] |= returns(g, calm)
    return out


def standstill_limit(runs: np.ndarray, counts: np.ndarray, n: int, least: int, log10_chance: float) -> float:
    """Length from which on a run of equal values is a standstill, from a source's n readings in `counts` runs of each length."""
    usual = runs < least  # from the short runs up to the fixed point, so that a long one never makes itself usual
    for _ in range(20):
        p = (float(((runs - 1) * counts)[usual].sum()) + 0.5) / (float((runs * counts)[usual].sum()) + 1)
        limit = 1 + (log10_chance - math.log10(n)) / math.log10(p)
        more = runs < max(limit, least)
        if (more == usual).all():
            break
        usual = more
    return max(limit, least)


def standstills(x: np.ndarray, before: tuple[int, float] | None, after: tuple[int, float, bool] | None, least: int, log10_chance: float, limit: float | None = None) -> np.ndarray:
    """Mask of the readings, from the second on, of runs of equal values far longer than the others.

    A run counts if, at the rate at which readings otherwise repeat their predecessor, fewer than 10 ** log10_chance
    such runs were to be expected. A run to the end of the source is none. before, after: length and value of the run
    next to this chunk, and whether the one after reaches the end of the source. limit: the source's, for a chunk.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if not n:
        return out
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    length = np.diff(edges)
    full = length.copy()
    joins_before = before is not None and before[0] > 0 and before[1] == x[0]
    joins_after = after is not None and after[0] > 0 and after[1] == x[-1]
    if joins_before:
        full[0] += before[0]
    if joins_after:
        full[-1] += after[0]
    if len(full) == 1 and joins_before and joins_after:
        full[0] = n + before[0] + after[0]
    last = after is None or (joins_after and after[2])
    if limit is None:
        runs = length[:-1] if last and len(length) > 1 else length
        limit = standstill_limit(runs, np.ones(len(runs), int), n, least, log10_chance)
    stuck = full >= limit
    if last:
        stuck[-1] = False
    for i in np.flatnonzero(stuck):
        out[edges[i] : edges[i + 1]] = True
        if not (i == 0 and joins_before):
            out[edges[i]] = False
    return out


def _tidy(pdf: pd.DataFrame) -> pd.DataFrame:
    """The readings of a group: one row per id, in order of time and id."""
    r = pdf[pdf["kind"] == 0].drop_duplicates("rec_id")
    r = r[r["value"].notna()]
    return r.sort_values(["ts", "rec_id"], kind="stable", na_position="first")


def _runs_at_ends(x: np.ndarray) -> tuple[int, int]:
    differs = np.flatnonzero(x != x[0])
    first = len(x) if not len(differs) else int(differs[0])
    differs = np.flatnonzero(x != x[-1])
    last = len(x) if not len(differs) else len(x) - 1 - int(differs[-1])
    return first, last


def _judge(pdf: pd.DataFrame, halo: pd.DataFrame | None, far: float, few: int, least: int, chance: float) -> pd.DataFrame:
    """The failing records of one chunk of a source, with the reason."""
    r = _tidy(pdf)
    ids, x, ts = r["rec_id"].to_numpy(), r["value"].to_numpy(float), r["ts"].to_numpy(float)
    ok = np.isfinite(x) & (x > 0)
    reason = np.full(len(x), "", object)
    reason[~ok] = "range"
    timed = ~np.isnan(ts)

    hx, hts, tx, tts, before, after, is_last, usual, limit = [], [], [], [], None, None, True, None, None
    if halo is not None and len(halo):
        h = halo.iloc[0]
        hx, hts, tx, tts = (np.asarray(h[c], float) for c in ("head_v", "head_t", "tail_v", "tail_t"))
        before = (int(h["run_before"]), float(h["value_before"]))
        is_last = bool(h["is_last"])
        after = None if is_last else (int(h["run_after"]), float(h["value_after"]), bool(h["to_end"]))
        usual, limit = h.to_dict(), float(h["stand_limit"])
        usual = {k: usual[k] for k in ("n", "move", "gap", "slot", "shift", "low", "high", "usual")}
    use = np.flatnonzero(ok & timed)
    log = np.log(np.concatenate([hx, x[use], tx]))
    times = np.concatenate([hts, ts[use], tts])
    off = len(hx)
    seen = Seen(log, times, slice(off, off + len(use)))
    usual = usual or usual_of_whole(seen, few)
    spike = spikes(seen, usual, far, few)
    mine = spike[off : off + len(use)]
    reason[use[mine]] = "spike"
    seq = np.flatnonzero(timed)
    stuck = standstills(x[seq], before, after, least, chance, limit)
    hit = seq[stuck]
    reason[hit[reason[hit] == ""]] = "standstill"

    out = [pd.DataFrame({"tab": "ohlc", "rec_id": ids[reason != ""], "reason": reason[reason != ""]})]
    ends = pdf[pdf["kind"] == 1].drop_duplicates("rec_id")
    ends = ends[ends["value"].notna()]
    if len(ends):
        v = ends["value"].to_numpy(float)
        bad = ~(np.isfinite(v) & (v > 0))
        calm = log[: off + len(use)][~spike[: off + len(use)]][-10:]
        far_out = np.zeros(len(v), bool)
        if len(calm) and usual["usual"] > 0:
            lv = np.log(np.where(bad, 1.0, v))
            far_out = ~bad & (np.maximum(calm.min() - lv, lv - calm.max()) > far * usual["usual"])
        why = np.where(bad, "range", "end")
        out.append(pd.DataFrame({"tab": "trim_info", "rec_id": ends["rec_id"].to_numpy()[bad | far_out], "reason": why[bad | far_out]}))
    return pd.concat(out).astype({"rec_id": "int64"})


_OUT = "tab string, rec_id long, reason string"
_ENDS = "source long, chunk int, head_t array<double>, head_v array<double>, tail_t array<double>, tail_v array<double>, first_run long, first_value double, last_run long, last_value double, runs array<long>, run_counts array<long>, n long"


def _timed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    r = _tidy(pdf)
    r = r[r["ts"].notna()]
    return r["ts"].to_numpy(float), r["value"].to_numpy(float)


def _chunk_ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one chunk, its first and last positive values, the runs at its ends, and the lengths of the runs between them."""
    ts, x = _timed(pdf)
    first, last = _runs_at_ends(x) if len(x) else (0, 0)
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)
    runs, counts = np.unique(np.diff(edges)[1:-1], return_counts=True)
    ok = np.isfinite(x) & (x > 0)
    row = {"source": key[0], "chunk": key[1], "head_t": ts[ok][:HALO], "head_v": x[ok][:HALO], "tail_t": ts[ok][-HALO:], "tail_v": x[ok][-HALO:], "first_run": first, "first_value": x[0] if len(x) else None, "last_run": last, "last_value": x[-1] if len(x) else None, "runs": runs, "run_counts": counts, "n": len(x)}
    return pd.DataFrame([row]) if len(x) else pd.DataFrame(columns=list(row))


_HALOS = "source long, chunk int, head_t array<double>, head_v array<double>, tail_t array<double>, tail_v array<double>, run_before long, value_before double, run_after long, value_after double, to_end boolean, is_last boolean, stand_limit double"


def _source_runs(c: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and counts of the runs of a source, put together from its chunks; the last run only if there is no other."""
    runs: Counter = Counter()
    length, value = 0, None
    for p in c.itertuples():
        if length and value == p.first_value:
            length += int(p.first_run)
        else:
            runs[length] += 1
            length = int(p.first_run)
        value = p.last_value
        if p.first_run < p.n:
            runs[length] += 1
            for k, m in zip(p.runs, p.run_counts):
                runs[int(k)] += int(m)
            length = int(p.last_run)
    del runs[0]
    runs = runs or Counter([length])
    return np.array([*runs]), np.array([*runs.values()])


def _exchange(pdf: pd.DataFrame, least: int, chance: float) -> pd.DataFrame:
    """Of one source, what each chunk sees of its neighbours; one row per chunk comes in."""
    c = pdf.sort_values("chunk").reset_index(drop=True)
    n, rows = len(c), []
    before = [(0, math.nan)] * n
    for i in range(1, n):  # run that ends where chunk i begins
        p = c.iloc[i - 1]
        run, value = int(p["last_run"]), float(p["last_value"])
        if run == p["n"] and before[i - 1][1] == value:
            run += before[i - 1][0]
        before[i] = (run, value)
    after: list[tuple[int, float, bool]] = [(0, math.nan, True)] * n
    for i in range(n - 2, -1, -1):  # run that begins where chunk i ends
        p = c.iloc[i + 1]
        run, value, whole = int(p["first_run"]), float(p["first_value"]), p["first_run"] == p["n"]
        to_end = bool(whole and i + 1 == n - 1)
        if whole and i + 1 < n - 1 and after[i + 1][1] == value:
            run, to_end = run + after[i + 1][0], after[i + 1][2]
        after[i] = (run, value, to_end)
    limit = standstill_limit(*_source_runs(c), int(c["n"].sum()), least, chance)
    none = np.zeros(0)
    heads, tails = [(none, none)] * n, [(none, none)] * n
    for i in range(1, n):  # over thin chunks, from further away
        heads[i] = tuple(np.concatenate([heads[i - 1][k], c.at[i - 1, name]])[-HALO:] for k, name in enumerate(("tail_t", "tail_v")))
    for i in range(n - 2, -1, -1):
        tails[i] = tuple(np.concatenate([c.at[i + 1, name], tails[i + 1][k]])[:HALO] for k, name in enumerate(("head_t", "head_v")))
    for i in range(n):
        rows.append({
            "source": c.at[i, "source"], "chunk": c.at[i, "chunk"],
            "head_t": heads[i][0], "head_v": heads[i][1], "tail_t": tails[i][0], "tail_v": tails[i][1],
            "run_before": before[i][0], "value_before": before[i][1], "run_after": after[i][0], "value_after": after[i][1],
            "to_end": after[i][2], "is_last": i == n - 1, "stand_limit": limit,
        })
    return pd.DataFrame(rows)


def _counted(key: tuple, **keys: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(keys).value_counts().rename("m").reset_index().assign(source=key[0])


def _seen(pdf: pd.DataFrame, halo: pd.DataFrame) -> Seen | None:
    ts, x = _timed(pdf)
    ok = np.isfinite(x) & (x > 0)
    if not len(halo) or not ok.any():
        return None
    h = halo.iloc[0]
    return Seen(np.log(np.concatenate([h["head_v"], x[ok], h["tail_v"]])), np.concatenate([h["head_t"], ts[ok], h["tail_t"]]), slice(len(h["head_v"]), len(h["head_v"]) + int(ok.sum())))


def _moves(key: tuple, pdf: pd.DataFrame, halo: pd.DataFrame) -> pd.DataFrame:
    """Counts of a chunk's moves (what 0) and time gaps (1), from the reading before it on, and of its readings (2)."""
    seen = _seen(pdf, halo)
    if seen is None:
        return pd.DataFrame({"source": [], "what": [], "k": [], "m": []})
    d, gap, n = seen.move_keys(), seen.gap_keys(), seen.own.stop - seen.own.start
    return _counted(key, what=np.repeat([0, 1, 2], [len(d), len(gap), n]), k=np.concatenate([d, gap, np.zeros(n, np.int64)]))


def _median_move(pdf: pd.DataFrame) -> pd.DataFrame:
    of = lambda i: tuple(pdf.loc[pdf["what"] == i, c].to_numpy() for c in ("k", "m"))
    return pd.DataFrame([{"source": pdf["source"].iloc[0]} | median_move(*of(0), *of(1), int(of(2)[1].sum()))])


def _usual(cut: DataFrame, halos: DataFrame, few: int) -> DataFrame:
    """(source, n, move, gap, slot, shift, low, high, usual): what is usual in each source that is cut.

    Four passes over the chunks, each after what the one before has added up: moves, season, deviates, ordinary moves.
    """
    chunks = cut.groupBy("source", "chunk")

    def passed(known: DataFrame, of_chunk, schema: str) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame, halo: pd.DataFrame) -> pd.DataFrame:
            seen = _seen(pdf, halo)
            if seen is None or halo["move"].iloc[0] <= 0:
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return of_chunk(key, seen, halo.iloc[0].to_dict())

        return chunks.cogroup(halos.join(known, "source").groupBy("source", "chunk")).applyInPandas(run, schema)

    def added(counts: DataFrame, known: DataFrame, names: list[str], put_together, schema: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            usual = pdf.iloc[0].to_dict()
            return pd.DataFrame([{"source": usual["source"]} | put_together(*(pdf[c].to_numpy() for c in (*names, "m")), usual)])

        of_source = counts.groupBy("source", *names).agg(F.sum("m").alias("m")).join(known, "source").groupBy("source")
        return cut_lineage(known.join(of_source.applyInPandas(run, f"source long, {schema}"), "source", "left"))

    counts = chunks.cogroup(halos.groupBy("source", "chunk")).applyInPandas(_moves, "source long, what int, k long, m long")
    counts = counts.groupBy("source", "what", "k").agg(F.sum("m").alias("m"))
    known = cut_lineage(counts.groupBy("source").applyInPandas(_median_move, "source long, n long, move double, gap double"))

    def slots_and_rests(key: tuple, seen: Seen, usual: dict) -> pd.DataFrame:
        slot, k = seen.season_keys(usual, few)
        return _counted(key, slot=slot, k=k)

    counts = passed(known, slots_and_rests, "source long, slot long, k long, m long")
    known = added(counts, known, ["slot", "k"], season, "slot array<long>, shift array<double>")
    counts = passed(known, lambda key, seen, usual: _counted(key, k=seen.rest(usual, few)[seen.own]), "source long, k long, m long")
    known = added(counts, known, ["k"], bounds, "low double, high double")

    def ordinary(key: tuple, seen: Seen, usual: dict) -> pd.DataFrame:
        total, moves = seen.ordinary_moves(usual, few)
        return pd.DataFrame([{"source": key[0], "total": total, "moves": moves}])

    sums = passed(known, ordinary, "source long, total double, moves long").groupBy("source").agg((F.sum("total") / F.sum("moves")).alias("mean"))
    return known.join(sums, "source", "left").withColumn("usual", F.coalesce("mean", "move")).drop("mean")


def implausible(readings: DataFrame, ends: DataFrame, far: float = 10.0, few: int = 5, least: int = 5, log10_chance: float = -4.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(tab, rec_id, reason): the records that do not fit the normal behaviour of their own source.

    readings: source long, ts, rec_id long, value; reported as tab `ohlc` with reason range (not a positive finite
    number), spike (a deviate more than `far` usual moves away from the level on both sides, for at most `few` readings) or
    standstill (a run of at least `least` equal values of which fewer than 10 ** log10_chance were to be expected,
    from its second reading on, unless it lasts to the source's end). ends: source long, rec_id long, value, an end
    value per source; reported as tab `trim_info` with reason range or end (more than `far` usual moves outside
    the last ten calm readings). Null values and record ids are no cases. Readings without a time are only checked
    for range. A null source is a source of its own. Repeated rows count once; ties in time go by rec_id; empty tables
    give an empty result.
    """
    r = readings.select(F.col("source").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("rec_id").cast("long"), F.col("value").cast("double"), F.lit(0).alias("kind")).filter("rec_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    e = ends.select(F.col("source").cast("long"), F.lit(None).cast("long").alias("ts"), F.col("rec_id").cast("long"), F.col("value").cast("double"), F.lit(1).alias("kind")).filter("rec_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    untimed = r.filter("ts IS NULL AND NOT (value > 0 AND value < double('inf'))").select(F.lit("ohlc").alias("tab"), "rec_id", F.lit("range").alias("reason")).distinct()
    r = r.filter("ts IS NOT NULL")
    per = readings.groupBy(F.col("source").cast("long").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    large = per.filter(F.col("n") > chunk_rows)
    args = (far, few, least, log10_chance)
    if within(large, 0):
        rows = r.unionByName(e)
        return rows.groupBy("source").applyInPandas(lambda pdf: _judge(pdf, None, *args), _OUT).unionByName(untimed)

    large = large.filter("source IS NOT NULL").withColumn("chunks", F.ceil(F.col("n") / chunk_rows).cast("int"))
    most = large.agg(F.max("chunks")).first()[0] or 1
    grid = [i / most for i in range(1, most)] or [0.5]
    timed = join_dimension(r.filter("ts IS NOT NULL").select("source", "ts"), large.select("source", "chunks"), "source")
    bounds = timed.groupBy("source", "chunks").agg(F.percentile_approx("ts", grid, max(10_000, 10 * most)).alias("q"), F.max("ts").alias("t1"))
    cuts = F.expr(f"array_distinct(filter(transform(sequence(1, chunks - 1), i -> q[cast(round(i * {most} / chunks) AS int) - 1]), b -> b < t1))")
    bounds = bounds.select("source", cuts.alias("cuts"))
    # the number of cuts before a reading, by bisection; end values go to the last chunk
    steps = ", ".join(str(1 << i) for i in reversed(range(most.bit_length())))
    at = F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= size(cuts) AND get(cuts, p + s - 1) < ts, p + s, p))")
    chunk = F.when(F.col("cuts").isNull(), 0).when(F.col("kind") == 1, F.size("cuts")).otherwise(at)
    rows = join_dimension(r.unionByName(e), bounds, "source", "left").withColumn("chunk", chunk)
    cut = rows.filter("cuts IS NOT NULL").drop("cuts")
    halos = cut.groupBy("source", "chunk").applyInPandas(_chunk_ends, _ENDS).groupBy("source").applyInPandas(lambda pdf: _exchange(pdf, least, log10_chance), _HALOS)
    halos = cut_lineage(halos)
    seen = halos.join(_usual(cut, halos, few), "source")
    together = rows.drop("cuts").groupBy("source", "chunk").cogroup(seen.groupBy("source", "chunk"))
    return together.applyInPandas(lambda pdf, halo: _judge(pdf, halo, *args), _OUT).unionByName(untimed)
