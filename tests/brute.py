"""Plain-Python answers on small input, to check the Spark operators against."""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby


def events(states, min_len=5):
    """[(event_id, start, [states])] by walking the recording sample by sample."""
    found, current, opens = [], None, 0
    for i, s in enumerate([*states, 2]):
        if s is None or s > 2:
            continue
        if s == 2:
            if current is not None:
                found.append(current)
            current, opens = None, opens + 1
        elif current is None:
            current = (opens, i, [s])
        else:
            current[2].append(s)
    return [e for e in found if len(e[2]) > min_len]


def features(seq):
    runs = [(k, len(list(g))) for k, g in groupby(seq)]
    out = {"event_duration": len(seq), "num_transitions": len(runs) - 1}
    out["entropy"] = -sum(c / len(seq) * math.log2(c / len(seq)) for c in Counter(seq).values()) + 0.0
    out["first_transition_time"] = runs[0][1] if len(runs) > 1 else -1
    for k in (0, 1):
        d = [n for s, n in runs if s == k]
        mean = sum(d) / len(d) if d else 0.0
        out[f"avg_dwell_{k}"] = mean
        out[f"var_dwell_{k}"] = sum((x - mean) ** 2 for x in d) / len(d) if d else 0.0
        out[f"longest_dwell_{k}"] = max(d, default=0)
        out[f"probability_{k}"] = seq.count(k) / len(seq)
    n0, n1 = seq.count(0), seq.count(1)
    out["ratio_0_to_1"] = n0 / n1 if n1 else float(n0)
    return out


def runs(states):
    """[(event_id, run_start, state, length)] including runs of short events."""
    out, opens, last = [], 0, None
    for i, s in enumerate(states):
        if s is None or s > 2:
            continue
        if s == 2:
            opens, last = opens + 1, None
        elif last is not None and last[2] == s:
            last[3] += 1
        else:
            last = [opens, i, s, 1]
            out.append(last)
    return [tuple(r) for r in out]
