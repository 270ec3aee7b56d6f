"""The scoring ladder and the boost for use, as Column expressions: no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tiers of the ladder, the charges for length, and the parts of the boost.
EXACT, PATH_START, NAME_EXACT, NAME_START, SEGMENT, INSIDE, WITH_ROOT = 10000.0, 9000.0, 8500.0, 8000.0, 7500.0, 7000.0, 6500.0
LENGTH_CHARGE, FUZZY_CHARGE = 0.1, 0.15
ADJACENT, APART, SEGMENT_START = 24.0, 6.0, 35.0
PINNED, USE_MOST, OPENS_MOST, OPENS_EACH, RECENT_MOST, RECENT_DAY, AFFINITY_MOST, AFFINITY_EACH = 2000.0, 300.0, 180.0, 40.0, 120.0, 10.0, 2500.0, 1200.0
DAY_MS = 86_400_000.0


def fuzzy(text: Column, query: str) -> Column:
    """Greedy leftmost subsequence score, null where the query is none. Characters are folded one by one, so the plan grows with the query, not the data."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"))
    chars = F.array(*map(F.lit, query))

    def step(state, ch):
        at = F.when(state["at"] >= 0, F.call_function("locate", ch, text, state["at"] + 1))
        found = at > 0
        # a first match can't be adjacent: there is none before it
        adjacent = (at == state["at"] + 1) & (state["at"] > 0)
        gain = F.when(adjacent, ADJACENT).otherwise(APART) + F.when((at == 1) | (F.substring(text, at - 1, F.lit(1)) == "/"), SEGMENT_START).otherwise(0.0)
        return F.struct(F.when(found, at).otherwise(-1).alias("at"), F.when(found, state["score"] + gain).otherwise(state["score"]).alias("score"))

    return F.aggregate(chars, start, step, lambda s: F.when(s["at"] > 0, s["score"] - F.length(text) * F.lit(FUZZY_CHARGE)))


def ladder(kind: Column, path: Column, name: Column, workspace: Column, query: str, use_fuzzy: bool = True) -> Column:
    """Double score of a normalized path for a normalized query, null where it doesn't match. The first tier that fits counts."""
    if not query:
        return F.when(kind == "directory", 10.0).otherwise(0.0)
    q = F.lit(query)
    whole = F.concat(workspace, F.lit("/"), path)
    size, whole_size = F.length(path), F.length(whole)
    at_segment, at, at_whole = F.instr(path, "/" + query), F.instr(path, query), F.instr(whole, query)
    out = (
        F.when(path == q, EXACT)
        .when(path.startswith(query), PATH_START - size)
        .when(name == q, NAME_EXACT)
        .when(name.startswith(query), NAME_START - F.length(name))
        .when(at_segment > 0, SEGMENT - (at_segment - 1) - size * F.lit(LENGTH_CHARGE))
        .when(at > 0, INSIDE - (at - 1) - size * F.lit(LENGTH_CHARGE))
        .when(whole == q, EXACT)
        .when(at_whole > 0, WITH_ROOT - (at_whole - 1) - whole_size * F.lit(LENGTH_CHARGE))
    )
    return (out.otherwise(fuzzy(whole, query)) if use_fuzzy else out).cast("double")


def may_match(path: Column, workspace: Column, query: str, use_fuzzy: bool = True) -> Column:
    """A cheap test that every match passes, so that the ladder runs on few rows."""
    whole = F.concat(workspace, F.lit("/"), path)
    if not use_fuzzy:
        return whole.contains(query)
    out = F.lit(True)
    for ch in dict.fromkeys(query):
        out = out & whole.contains(ch)
    return out


def boost(pinned: Column, last_ms: Column, opens: Column, affinity: Column, now_ms: int) -> Column:
    """What use adds: pinning, how often and how lately opened, how often chosen for this query; rounded to 6 places."""
    days = F.greatest(F.lit(0.0), (F.lit(float(now_ms)) - last_ms) / F.lit(DAY_MS))
    use = F.least(F.lit(USE_MOST), F.least(F.lit(OPENS_MOST), F.log2(opens + 1.0) * OPENS_EACH) + F.greatest(F.lit(0.0), RECENT_MOST - days * RECENT_DAY))
    chosen = F.least(F.lit(AFFINITY_MOST), F.log2(F.coalesce(affinity, F.lit(0)) + 1.0) * AFFINITY_EACH)
    return F.round(F.when(pinned, PINNED).otherwise(0.0) + use + chosen, 6)
