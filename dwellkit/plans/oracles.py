"""The same queries as SQL over the driver's tables, written without regard to scale."""

from __future__ import annotations

from dwellkit.operators.features import FEATURES_10, FEATURES_12, FEATURES_13, FEATURES_20
from dwellkit.operators.metrics import THRESHOLDS

# Fixed values, stated here again so that the SQL does not follow a change in the queries.
DOWNSAMPLE = [x * 0.80 for x in [0.6163, 0.4340, 0.4446, 0.5652, 0.6163, 0.8829, 1.0000]]
MIXTURE_NAMES = {"class_0": 0.6, "class_3": 0.4}
PAIRS = [(0, 2), (2, 3)]
WINDOW = (0.010, 0.030)
N_CLASSES, SCORE_CLASSES, DIMENSIONS = 7, 10, 64


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r6(*names: str, src: str = "") -> str:
    return ", ".join(f"round({src}{n}, 6) + 0.0 AS {n}" for n in names)


SIG = f"""sig AS (
  SELECT user_id AS record_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * {d(0.001)} AS time,
         value AS current,
         CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS state
  FROM events)"""

SIG_LINEITEM = f"""sig AS (
  SELECT l_suppkey AS record_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice) - 1 AS sample_idx,
         l_quantity AS current,
         CASE WHEN l_quantity <= 20 THEN 0 WHEN l_quantity <= 40 THEN 1 ELSE 2 END AS state
  FROM lineitem)"""

RUNS = """isl AS (
  SELECT record_id, sample_idx, state,
         CAST(sum(CASE WHEN state = 2 THEN 1 ELSE 0 END)
              OVER (PARTITION BY record_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id
  FROM sig WHERE state <= 2),
inside AS (
  SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY record_id, event_id ORDER BY sample_idx)
            THEN 1 ELSE 0 END AS turn
  FROM isl WHERE state < 2),
numbered AS (
  SELECT *, sum(turn) OVER (PARTITION BY record_id, event_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS run_no
  FROM inside),
runs AS (
  SELECT record_id, event_id, run_no, state, count(*) AS run_len, min(sample_idx) AS run_start
  FROM numbered GROUP BY record_id, event_id, run_no, state)"""

FEATURES = """per_state AS (
  SELECT record_id, event_id, state, sum(run_len) AS n FROM runs GROUP BY record_id, event_id, state),
ent AS (
  SELECT record_id, event_id, sum(-(n / total) * log2(n / total)) AS entropy
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY record_id, event_id) AS DOUBLE) AS total FROM per_state)
  GROUP BY record_id, event_id),
feat AS (
  SELECT record_id, event_id,
    CAST(CASE WHEN count(*) > 1 THEN max(CASE WHEN run_no = 0 THEN run_len END) ELSE -1 END AS BIGINT)
      AS first_transition_time,
    coalesce(avg(CASE WHEN state = 0 THEN run_len END), 0.0) AS avg_dwell_0,
    coalesce(avg(CASE WHEN state = 1 THEN run_len END), 0.0) AS avg_dwell_1,
    coalesce(var_pop(CASE WHEN state = 0 THEN run_len END), 0.0) AS var_dwell_0,
    coalesce(var_pop(CASE WHEN state = 1 THEN run_len END), 0.0) AS var_dwell_1,
    coalesce(max(CASE WHEN state = 0 THEN run_len END), 0) AS longest_dwell_0,
    coalesce(max(CASE WHEN state = 1 THEN run_len END), 0) AS longest_dwell_1,
    CAST(sum(run_len) AS BIGINT) AS event_duration,
    CAST(sum(CASE WHEN state = 0 THEN run_len ELSE 0 END) AS DOUBLE) AS n0,
    CAST(sum(CASE WHEN state = 1 THEN run_len ELSE 0 END) AS DOUBLE) AS n1,
    count(*) - 1 AS num_transitions
  FROM runs GROUP BY record_id, event_id HAVING sum(run_len) > 5),
ev AS (
  SELECT feat.*, ent.entropy, n0 / event_duration AS probability_0, n1 / event_duration AS probability_1,
    CASE WHEN n1 > 0 THEN n0 / n1 ELSE n0 END AS ratio_0_to_1,
    CAST(feat.record_id % 7 AS INTEGER) AS label
  FROM feat JOIN ent USING (record_id, event_id))"""


def record_stats(mode: str) -> str:
    def pick(name: str) -> str:
        return f"avg({name})" if mode == "mean" else f"CAST(arg_min({name}, event_id) AS DOUBLE)"

    return f"""rec AS (
  SELECT record_id, {pick("event_duration")} AS average_event_length, {pick("entropy")} AS average_event_entropy,
    {pick("first_transition_time")} AS average_first_transition_time,
    {pick("num_transitions")} AS average_num_transitions,
    sum(n0) / sum(event_duration) AS overall_probability_0, sum(n1) / sum(event_duration) AS overall_probability_1,
    CASE WHEN sum(n1) > 0 THEN sum(n0) / sum(n1) ELSE sum(n0) END AS overall_ratio_0_to_1
  FROM ev GROUP BY record_id)"""


RECORD_NAMES = FEATURES_20[13:]
INT_FEATURES = {"first_transition_time", "longest_dwell_0", "longest_dwell_1", "event_duration", "num_transitions"}


def feature_list(names) -> str:
    return ", ".join(n if n in INT_FEATURES else r6(n) for n in names)


BASE = f"WITH {SIG}, {RUNS}"
EVENTS = f"{BASE}, {FEATURES}"

# Linear discriminant, each half of the vectors by the fit of the other one: pooled covariance
# plus its mean variance on the diagonal, next to the class means, eliminated row by row.
SCORES = f"""comp AS (
  SELECT vec_id AS id, label, CAST(vec_id % 2 AS INTEGER) AS fold, unnest(range(1, {DIMENSIONS + 1})) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mu AS (SELECT 1 - fold AS fit, label AS class, i, avg(x) AS m, count(*) AS n FROM comp GROUP BY ALL),
prior AS (SELECT fit, class, n, n / sum(n) OVER (PARTITION BY fit)::DOUBLE AS p FROM mu WHERE i = 1),
gram AS (SELECT 1 - a.fold AS fit, a.i, b.i AS j, sum(a.x * b.x) AS s FROM comp a JOIN comp b ON a.id = b.id GROUP BY ALL),
between AS (SELECT a.fit, a.i, b.i AS j, sum(a.n * a.m * b.m) AS s FROM mu a JOIN mu b ON a.fit = b.fit AND a.class = b.class
            GROUP BY ALL),
within AS (SELECT g.fit, g.i, g.j, (g.s - b.s) / (SELECT sum(n) FROM prior p WHERE p.fit = g.fit) AS s
           FROM gram g JOIN between b ON b.fit = g.fit AND b.i = g.i AND b.j = g.j),
solid AS (SELECT fit, i, j, s + CASE WHEN i = j THEN sum(CASE WHEN i = j THEN s END) OVER (PARTITION BY fit) / {DIMENSIONS}
                                     ELSE 0 END AS s FROM within),
beside AS (SELECT fit, i, j, s FROM solid UNION ALL SELECT fit, i, {DIMENSIONS} + 1 + class, m FROM mu),
start AS (SELECT fit, list(r ORDER BY i) AS m FROM (SELECT fit, i, list(s ORDER BY j) AS r FROM beside GROUP BY fit, i)
          GROUP BY fit),
steps AS (
  SELECT fit, 1 AS k, m FROM start
  UNION ALL
  SELECT fit, k + 1, list_transform(range(1, {DIMENSIONS + 1}), lambda i: CASE WHEN i = k THEN p
      ELSE list_transform(range(1, {DIMENSIONS + SCORE_CLASSES + 1}), lambda j: m[i][j] - m[i][k] * p[j]) END)
  FROM (SELECT fit, k, m, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM steps WHERE k <= {DIMENSIONS})),
weight AS (
  SELECT fit, class, i, m[i][{DIMENSIONS} + 1 + class] AS w
  FROM (SELECT fit, m FROM steps WHERE k = {DIMENSIONS + 1}), (SELECT unnest(range({SCORE_CLASSES})) AS class),
       (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i)),
offs AS (SELECT fit, class, ln(any_value(p)) - 0.5 * sum(m * w) AS b
         FROM weight JOIN mu USING (fit, class, i) JOIN prior USING (fit, class) GROUP BY fit, class),
logs AS (SELECT id, label, class, sum(x * w) + any_value(b) AS s
         FROM comp JOIN weight ON weight.fit = comp.fold AND weight.i = comp.i JOIN offs USING (fit, class) GROUP BY ALL),
shares AS (SELECT id, label, class, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM logs),
scores AS (SELECT id, label, list(e / total ORDER BY class) AS probs
           FROM (SELECT *, sum(e) OVER (PARTITION BY id) AS total FROM shares) GROUP BY id, label),
preds AS (
  SELECT id, label, list_max(probs) AS top, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS best
  FROM scores),
gated AS (SELECT id, label, CASE WHEN top >= {d(0.20)} THEN best END AS pred FROM preds)"""
SCORES = "RECURSIVE " + SCORES

CELLS = f"""ids AS (SELECT CAST(range AS INTEGER) AS i FROM range({SCORE_CLASSES})),
cells AS (
  SELECT a.i AS label, b.i AS pred, count(p.id) AS n
  FROM ids a CROSS JOIN ids b LEFT JOIN preds p ON p.label = a.i AND p.best = b.i GROUP BY a.i, b.i)"""

PER_CLASS = """sides AS (
  SELECT label AS c, n AS support, 0 AS predicted, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM cells
  UNION ALL SELECT pred, 0, n, 0 FROM cells),
sums AS (SELECT c AS label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS DOUBLE) AS predicted,
                CAST(sum(tp) AS DOUBLE) AS tp FROM sides GROUP BY c),
per_class AS (
  SELECT label, support, predicted, tp,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM sums)"""

REPORT = """report AS (
  SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM per_class
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)"""

BINARY_SCORES = """bs AS (
  SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
         value / (SELECT max(value) FROM events) AS score FROM events)"""

RATES = """CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn)::DOUBLE ELSE 0.0 END AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1,
    CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0
      THEN (tp::DOUBLE * tn - fp::DOUBLE * fn)
           / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0.0 END AS mcc"""
RATE_NAMES = ("accuracy", "precision", "recall", "f1", "mcc")

VOTES = f"""ids AS (SELECT CAST(range AS INTEGER) AS i FROM range({SCORE_CLASSES})),
streams AS (SELECT DISTINCT label AS stream FROM preds),
vc AS (
  SELECT s.stream, i AS pred, count(p.id) AS n
  FROM streams s CROSS JOIN ids LEFT JOIN preds p ON p.label = s.stream AND p.best = i GROUP BY s.stream, i),
tot AS (SELECT stream, CAST(sum(n) AS BIGINT) AS total_votes, max(n) AS top FROM vc GROUP BY stream)"""


def pattern(log: str, rank: str) -> str:
    return f"""{VOTES}, pat AS (
  SELECT t.stream, t.stream AS label,
    (SELECT min(pred) FROM vc WHERE vc.stream = t.stream AND n = t.top) AS winner,
    top / total_votes::DOUBLE AS confidence,
    (SELECT sum(CASE WHEN n > 0 THEN -(n / total_votes::DOUBLE) * {log}(n / total_votes::DOUBLE) ELSE 0.0 END)
     FROM vc WHERE vc.stream = t.stream) AS entropy,
    (SELECT CAST(count(*) + 1 AS INTEGER) FROM vc JOIN vc own ON own.stream = t.stream AND own.pred = t.stream
     WHERE vc.stream = t.stream AND ({rank})) AS rank,
    total_votes
  FROM tot t),
patterns AS (SELECT stream, label, winner, CASE WHEN winner = label THEN 1 ELSE 0 END AS top1, confidence, entropy,
                    rank, total_votes FROM pat)"""


STRICT_RANK = "vc.n > own.n"
VOTED_RANK = "vc.n > own.n OR (vc.n = own.n AND vc.pred < own.pred)"

DRAWN = f"""drawn AS (
  SELECT id, label FROM (
    SELECT vec_id AS id, label,
      row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':mix'), vec_id) AS rn FROM embeddings)
  WHERE rn <= CASE label WHEN 0 THEN 30 WHEN 3 THEN 20 END),
mine AS (SELECT * FROM gated WHERE id IN (SELECT id FROM drawn))"""

MIXED = f"""{DRAWN}, ids AS (SELECT CAST(range AS INTEGER) AS i FROM range({SCORE_CLASSES})),
mixed AS (
  SELECT i AS label,
    (SELECT count(*) FROM mine WHERE label = i) / (SELECT count(*) FROM mine)::DOUBLE AS actual,
    coalesce((SELECT count(*) FROM mine WHERE pred = i) / nullif((SELECT count(pred) FROM mine), 0)::DOUBLE, 0.0)
      AS predicted
  FROM ids)"""

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT label, '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS value FROM ev" for f in FEATURES_10
) + ")"

PCT = f"""pct AS (
  SELECT label, feature, quantile_cont(value, {d(0.05)}) AS p05, quantile_cont(value, {d(0.95)}) AS p95
  FROM long GROUP BY label, feature)"""

PAIR_TABLE = "pairs AS (" + " UNION ALL ".join(
    f"SELECT CAST({a} AS INTEGER) AS first, CAST({b} AS INTEGER) AS second" for a, b in PAIRS
) + ")"

SPAN = """span AS (
  SELECT label, feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM long GROUP BY label, feature)"""

GUESS = "least(floor((value - lo) / (hi - lo) * 50), 49)"
BIN = f"""CAST(CASE WHEN value < lo + {GUESS} * ((hi - lo) / 50) THEN {GUESS} - 1
  WHEN value >= lo + ({GUESS} + 1) * ((hi - lo) / 50) AND {GUESS} < 49 THEN {GUESS} + 1 ELSE {GUESS} END AS INTEGER)"""


def histogram(span: str) -> str:
    return f"""{EVENTS}, {LONG}, {SPAN}, edges AS ({span}),
counted AS (SELECT label, feature, {BIN} AS bin, count(*) AS n FROM long JOIN edges USING (label, feature)
            GROUP BY ALL),
spine AS (SELECT e.*, CAST(range AS INTEGER) AS bin FROM edges e CROSS JOIN range(50)),
h AS (SELECT s.label, s.feature, s.bin, lo + s.bin * ((hi - lo) / 50) AS bin_low,
             lo + (s.bin + 1) * ((hi - lo) / 50) AS bin_high, coalesce(n, 0) AS n,
             coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY s.label, s.feature) * ((hi - lo) / 50)) AS density
      FROM spine s LEFT JOIN counted c ON s.label = c.label AND s.feature = c.feature AND s.bin = c.bin)
SELECT label, feature, bin, n, {r6("bin_low", "bin_high", "density")} FROM h"""


def overlapping(edges: str) -> str:
    who = "s.label = p.first" if edges == "first" else "s.label IN (p.first, p.second)"
    return f"""{EVENTS}, {LONG}, {SPAN}, {PAIR_TABLE},
edges AS (SELECT first, second, feature, min(lo) AS lo, max(hi) AS hi FROM pairs p JOIN span s ON {who}
          GROUP BY first, second, feature),
binned AS (
  SELECT e.first, e.second, e.feature, (hi - lo) / 50 AS width, {BIN} AS bin,
         count(*) FILTER (WHERE label = e.first) AS n1, count(*) FILTER (WHERE label = e.second) AS n2
  FROM edges e JOIN long l ON l.feature = e.feature AND l.label IN (e.first, e.second)
  WHERE value BETWEEN lo AND hi GROUP BY ALL),
dens AS (
  SELECT first, second, feature, width,
    n1 / (sum(n1) OVER w * width) AS d1,
    CASE WHEN sum(n2) OVER w > 0 THEN n2 / (sum(n2) OVER w * width) ELSE 0.0 END AS d2
  FROM binned WINDOW w AS (PARTITION BY first, second, feature)),
ov AS (
  SELECT first, second, feature, sum(d1 * width) AS mass_1, sum(d2 * width) AS mass_2,
         least(sum(sqrt(d1 * d2) * width), 1.0) AS coefficient, sum(least(d1, d2) * width) AS overlap_area
  FROM dens GROUP BY first, second, feature),
result AS (
  SELECT *, CASE WHEN coefficient > 0 THEN greatest(-ln(coefficient), 0.0) ELSE 'infinity'::DOUBLE END AS distance
  FROM ov)"""


DWELLS = f"""{BASE}, dwell AS (
  SELECT CAST(record_id % 7 AS INTEGER) AS label, 'state_' || state AS kind, run_len AS length FROM runs
  UNION ALL
  SELECT CAST(record_id % 7 AS INTEGER), 'event', CAST(sum(run_len) AS BIGINT) FROM runs GROUP BY record_id, event_id),
hist AS (SELECT label, kind, length, count(*) AS n FROM dwell GROUP BY label, kind, length)"""


CDF = f"""{DWELLS}, c AS (
  SELECT label, kind, length * {d(0.001)} AS t, n,
    CAST(sum(n) OVER (PARTITION BY label, kind ORDER BY length ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
    CAST(sum(n) OVER (PARTITION BY label, kind) AS BIGINT) AS total FROM hist),
p AS (SELECT *, (cum - n + 1) / total::DOUBLE AS p_first, cum / total::DOUBLE AS p_last,
             (cum - n + (n + 1) / 2.0) / total::DOUBLE AS p_mean FROM c)"""


def fitted(steps: int = 64) -> str:
    """Rate constants by bisection of the slope of the squared error."""
    lines = ["k0 AS MATERIALIZED (SELECT DISTINCT label, kind, 0.0::DOUBLE AS lo, 1e5::DOUBLE AS hi FROM p)"]
    for i in range(steps):
        lines.append(
            f"""k{i + 1} AS MATERIALIZED (
  SELECT label, kind, CASE WHEN up THEN mid ELSE lo END AS lo, CASE WHEN up THEN hi ELSE mid END AS hi
  FROM (SELECT k.label, k.kind, lo, hi, (lo + hi) / 2 AS mid,
          sum(n * (p_mean - 1 + exp(-(lo + hi) / 2 * t)) * t * exp(-(lo + hi) / 2 * t)) > 0 AS up
        FROM k{i} k JOIN p ON p.label = k.label AND p.kind = k.kind GROUP BY k.label, k.kind, lo, hi))"""
        )
    return ", ".join(lines)


def drawn(ids: str, seed: str) -> str:
    text = " || ':' || ".join(f"CAST({c.strip()} AS VARCHAR)" for c in ids.split(","))
    return f"md5({text} || ':{seed}')"


def ranked(group: str, seed: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    whole = f"PARTITION BY {group}" if group else ""
    return f"""ranked AS (
  SELECT record_id, event_id, label, event_duration,
    row_number() OVER ({part}ORDER BY {drawn("record_id, event_id", seed)}, record_id, event_id) AS rn,
    count(*) OVER ({whole}) AS n FROM ev)"""


SPLIT = f"{EVENTS}, {ranked('label', '42')}, split AS (SELECT *, rn <= round(n * {d(0.2)}) AS is_test FROM ranked)"
FRACTION_CASE = "CASE label " + " ".join(f"WHEN {i} THEN {d(f)}" for i, f in enumerate(DOWNSAMPLE)) + " END"
STATES = """seqs AS (
  SELECT record_id, event_id, list(CAST(state AS INTEGER) ORDER BY sample_idx) AS states, count(*) AS event_duration
  FROM inside GROUP BY record_id, event_id HAVING count(*) > 5)"""


def padded_sql(kept: str) -> str:
    return f"""{SPLIT}, {STATES},
longest AS (SELECT CAST(max(event_duration) AS BIGINT) AS l FROM split WHERE NOT is_test),
filled AS (SELECT record_id, event_id, l, list_concat({kept}, [-1 FOR x IN range(greatest(0, l - len(states)))]) AS whole
           FROM seqs, longest),
cut AS (SELECT *, unnest(range(0, CAST(ceil(l / 32.0) AS BIGINT))) AS part FROM filled)
SELECT record_id, event_id, part, array_to_string(whole[part * 32 + 1:part * 32 + 32], ',') AS padded FROM cut"""


KINETIC = f"""{EVENTS}, {record_stats('mean')}, lab AS (
  SELECT ev.* EXCLUDE (label), {" + ".join(f"CASE WHEN overall_probability_0 >= {d(x)} THEN 1 ELSE 0 END"
                                             for x in (0.38, 0.44, 0.48, 0.52, 0.56, 0.62))} AS label
  FROM ev JOIN rec USING (record_id)),
groups AS (SELECT record_id, label, count(*) AS n, {drawn("record_id", "42")} AS h FROM lab GROUP BY record_id, label),
halves AS (
  SELECT record_id, label, coalesce(sum(n) OVER (PARTITION BY label ORDER BY h, record_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < round(sum(n) OVER (PARTITION BY label) * {d(0.2)}) AS is_test FROM groups),
kin AS (SELECT lab.*, is_test FROM lab JOIN halves USING (record_id, label))"""

PATTERNS = """following AS (
  SELECT record_id, event_id, CAST(state AS VARCHAR) AS a, CAST(lead(state, 1) OVER w AS VARCHAR) AS b,
         CAST(lead(state, 2) OVER w AS VARCHAR) AS c
  FROM inside WINDOW w AS (PARTITION BY record_id, event_id ORDER BY sample_idx)),
pats AS (
  SELECT record_id, event_id, pattern, count(*) AS n FROM (
    SELECT record_id, event_id, a AS pattern FROM following
    UNION ALL SELECT record_id, event_id, a || ',' || b FROM following
    UNION ALL SELECT record_id, event_id, a || ',' || b || ',' || c FROM following)
  WHERE pattern IS NOT NULL GROUP BY ALL)"""

# Training rows with the last fifth, in hash order, for validation.
VALIDATED = f"""train AS (
  SELECT *, rn > floor(n_train * {d(0.8)}) AS is_validation FROM (
    SELECT *, count(*) OVER () AS n_train,
      row_number() OVER (ORDER BY {drawn("record_id, event_id", "val")}, record_id, event_id) AS rn FROM kin WHERE NOT is_test))"""


def tall(name: str, rows: str, names) -> str:
    """One row per event and feature."""
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT record_id, event_id, label, '{f}' AS f, CAST({f} AS DOUBLE) AS x FROM ({rows})" for f in names
    ) + ")"


def bayes(name: str, train: str, scored: str, names, sequence: bool) -> str:
    """Log scores ``<name>_log(record_id, event_id, label, cls, s)`` and ``<name>_pred``."""
    parts = [
        f"{name}_prior AS (SELECT label AS cls, ln(count(*) / (SELECT count(*) FROM ({train}))::DOUBLE) AS p FROM ({train}) GROUP BY label)"
    ]
    sums = []
    if names:
        parts += [
            tall(f"{name}_tall", train, names),
            f"""{name}_all AS (SELECT f, var_pop(x) AS v FROM {name}_tall GROUP BY f),
{name}_moments AS (
  SELECT label AS cls, t.f, avg(x) AS mean, var_pop(x) + {d(0.01)} * any_value(a.v) + {d(1e-9)} AS v
  FROM {name}_tall t JOIN {name}_all a ON a.f = t.f GROUP BY label, t.f)""",
            tall(f"{name}_rows", scored, names),
            f"""{name}_features AS (
  SELECT record_id, event_id, cls, sum(-0.5 * ln(2 * pi() * v) - (x - mean) * (x - mean) / (2 * v)) AS s
  FROM {name}_rows r JOIN {name}_moments m ON m.f = r.f GROUP BY record_id, event_id, cls)""",
        ]
        sums.append(f"SELECT * FROM {name}_features")
    if sequence:
        parts.append(f"""{name}_totals AS (
  SELECT label AS cls, pattern, sum(n) AS t FROM ({train}) JOIN pats USING (record_id, event_id)
  WHERE pattern LIKE '%,%' GROUP BY ALL),
{name}_share AS (
  SELECT cls, pattern, ln((t + 1) / (sum(t) OVER w + count(*) OVER w)::DOUBLE) AS p FROM (
    SELECT c.cls, v.pattern, coalesce(t, 0) AS t FROM {name}_prior c
    CROSS JOIN (SELECT DISTINCT pattern FROM {name}_totals) v
    LEFT JOIN {name}_totals s ON s.cls = c.cls AND s.pattern = v.pattern)
  WINDOW w AS (PARTITION BY cls, len(pattern))),
{name}_patterns AS (
  SELECT record_id, event_id, cls, sum(n * p) AS s FROM ({scored}) JOIN pats USING (record_id, event_id)
  JOIN {name}_share USING (pattern) GROUP BY record_id, event_id, cls)""")
        sums.append(f"SELECT * FROM {name}_patterns")
    parts.append(f"""{name}_log AS (
  SELECT e.record_id, e.event_id, e.label, q.cls, any_value(q.p) + coalesce(sum(u.s), 0) AS s
  FROM ({scored}) e CROSS JOIN {name}_prior q
  LEFT JOIN ({" UNION ALL ".join(sums)}) u ON u.record_id = e.record_id AND u.event_id = e.event_id AND u.cls = q.cls
  GROUP BY e.record_id, e.event_id, e.label, q.cls),
{name}_pred AS (
  SELECT record_id, event_id, label, arg_min(cls, (-s, cls)) AS best FROM {name}_log GROUP BY record_id, event_id, label)""")
    return ", ".join(parts)


CANDIDATES = {"features": (FEATURES_12, False), "patterns": ([], True), "both": (FEATURES_12, True)}
FITTED = "SELECT * FROM train WHERE NOT is_validation"
SELECTION = f"{KINETIC}, {PATTERNS}, {VALIDATED}, " + ", ".join(
    bayes(f"v_{c}", FITTED, "SELECT * FROM train WHERE is_validation", *how) for c, how in CANDIDATES.items()
) + ", judged AS (" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS candidate, label, best FROM v_{c}_pred" for i, c in enumerate(CANDIDATES)
) + """),
hits AS (
  SELECT place, candidate, cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT place, candidate, label AS cls, 1 AS support, 0 AS predicted, CASE WHEN label = best THEN 1 ELSE 0 END AS tp FROM judged
    UNION ALL SELECT place, candidate, best, 0, 1, 0 FROM judged) GROUP BY ALL),
macro AS (SELECT place, candidate, avg(2 * tp / (support + predicted)::DOUBLE) AS macro_f1 FROM hits GROUP BY ALL),
chosen AS (SELECT candidate FROM macro ORDER BY macro_f1 DESC, place LIMIT 1)"""


def class_cells(preds: str, k: int) -> str:
    return f"""ids AS (SELECT CAST(range AS INTEGER) AS i FROM range({k})),
cells AS (SELECT a.i AS label, b.i AS pred, count(p.best) AS n
  FROM ids a CROSS JOIN ids b LEFT JOIN ({preds}) p ON p.label = a.i AND p.best = b.i GROUP BY a.i, b.i)"""


TEST = "SELECT * FROM kin WHERE is_test"
NOT_TEST = "SELECT * FROM kin WHERE NOT is_test"

NOISY = f"""WITH raw AS (
  SELECT l_suppkey AS record_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice) - 1 AS sample_idx,
         l_quantity + (l_discount + l_tax) * {d(100.0)} AS current,
         CASE WHEN l_quantity <= 20 THEN 0 WHEN l_quantity <= 40 THEN 1 ELSE 2 END AS state
  FROM lineitem),
span AS (SELECT record_id, min(current) AS lo, max(current) AS hi, count(*) AS n, {drawn("record_id", "42")} AS h
         FROM raw GROUP BY record_id),
held AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY h, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            < round(sum(n) OVER () * {d(0.2)}) AS is_test FROM span),
binned AS (
  SELECT raw.*, is_test, CAST(greatest(least(floor(CASE WHEN hi > lo THEN (current - lo) / (hi - lo) ELSE 0.0 END
      * {d(64.0)}), 63), 0) AS INTEGER) AS bin
  FROM raw JOIN held USING (record_id))"""


def state_model(truth: str, k: int) -> str:
    return f"""{NOISY}, known AS (SELECT *, {truth} AS label FROM binned),
totals AS (SELECT CAST(range AS INTEGER) AS label, (SELECT count(*) FROM known WHERE label = range AND NOT is_test) AS t FROM range({k})),
joint AS (
  SELECT label, b.bin, t * ((SELECT count(*) FROM known k WHERE k.label = totals.label AND k.bin = b.bin AND NOT is_test)
      + {d(1.0)}) / (t + {d(64.0)}) AS p
  FROM totals, (SELECT CAST(range AS INTEGER) AS bin FROM range(64)) b),
posterior AS (SELECT bin, list(p / total ORDER BY label) AS probs, CAST(list_position(list(p ORDER BY label), max(p)) - 1 AS INTEGER) AS best
  FROM (SELECT *, sum(p) OVER (PARTITION BY bin) AS total FROM joint) GROUP BY bin),
scored AS (SELECT known.*, probs, best FROM known JOIN posterior USING (bin) WHERE is_test)"""

ORACLES: dict[str, str] = {
    "signal_time_window": f"""WITH {SIG} SELECT record_id, sample_idx, state, {r6("time", "current")} FROM sig
WHERE time BETWEEN {d(WINDOW[0])} AND {d(WINDOW[1])}""",
    "signal_sample_range": f"""WITH {SIG} SELECT record_id, sample_idx, state, {r6("time", "current")} FROM sig
WHERE sample_idx >= 20 AND sample_idx < 50""",
    "signal_preview": f"""WITH {SIG} SELECT record_id, sample_idx, state, {r6("time", "current")} FROM sig
WHERE sample_idx < 10""",
    "signal_minmax_scaled": f"""WITH {SIG}, s AS (
  SELECT record_id, sample_idx, CASE WHEN max(current) OVER w > min(current) OVER w
    THEN (current - min(current) OVER w) / (max(current) OVER w - min(current) OVER w) ELSE 0.0 END AS scaled
  FROM sig WINDOW w AS (PARTITION BY record_id))
SELECT record_id, sample_idx, {r6("scaled")} FROM s""",
    "signal_nonzero_moments": f"""WITH {SIG}, m AS (
  SELECT record_id, count(*) AS n_samples, count(*) FILTER (WHERE current <> 0) AS n_nonzero,
         sum(current) / count(*) FILTER (WHERE current <> 0) AS nonzero_mean FROM sig GROUP BY record_id),
s AS (SELECT m.*, sqrt((SELECT sum((current - nonzero_mean) * (current - nonzero_mean)) FROM sig
                        WHERE sig.record_id = m.record_id) / n_nonzero) AS nonzero_sd FROM m)
SELECT record_id, n_samples, n_nonzero, {r6("nonzero_mean", "nonzero_sd")} FROM s""",
    "signal_smooth3": f"""WITH {SIG}, s AS (
  SELECT record_id, sample_idx, avg(current) OVER (PARTITION BY record_id ORDER BY sample_idx
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM sig)
SELECT record_id, sample_idx, {r6("smoothed")} FROM s""",
    "signal_smooth3_median": f"""WITH {SIG}, s AS (
  SELECT record_id, sample_idx, median(current) OVER (PARTITION BY record_id ORDER BY sample_idx
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM sig)
SELECT record_id, sample_idx, {r6("smoothed")} FROM s""",
    "state_distribution": f"""WITH {SIG}, c AS (SELECT record_id, state, count(*) AS n FROM sig GROUP BY record_id, state),
f AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY record_id) AS DOUBLE) AS fraction FROM c)
SELECT record_id, state, n, {r6("fraction")} FROM f""",
    "state_recode_binary": f"""WITH {SIG} SELECT record_id, CASE WHEN state > 0 THEN 1 ELSE 0 END AS binary_state,
  count(*) AS n FROM sig GROUP BY ALL""",
    "number_of_states": f"""WITH {SIG} SELECT record_id, max(state) + 1 AS num_states,
  count(DISTINCT state) AS distinct_states FROM sig GROUP BY record_id""",
    "species_lookup": """SELECT CAST(event_id % 4 AS INTEGER) AS species,
  CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS state,
  CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS DOUBLE) AS level,
  count(*) AS n FROM events GROUP BY ALL""",
    "transition_matrix": f"""WITH {SIG}, p AS (
  SELECT record_id, state, lead(state) OVER (PARTITION BY record_id ORDER BY sample_idx) AS next_state FROM sig),
c AS (SELECT record_id, state, next_state, count(*) AS n FROM p WHERE next_state IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY record_id, state) AS DOUBLE) AS p FROM c)
SELECT record_id, state, next_state, n, {r6("p")} FROM s""",
    "segment_events": f"""{BASE}, k AS (
  SELECT *, sum(run_len) OVER (PARTITION BY record_id, event_id) AS total,
    min(run_start) OVER (PARTITION BY record_id, event_id) AS start_idx FROM runs)
SELECT record_id, event_id, (run_start - start_idx) // 1048576 AS part, CAST(total AS BIGINT) AS event_duration,
  string_agg(state || 'x' || run_len, ',' ORDER BY run_start) AS runs
FROM k WHERE total > 5 GROUP BY 1, 2, 3, 4""",
    "event_bounds": f"""{BASE} SELECT record_id, event_id, min(sample_idx) AS start_idx, count(*) AS event_duration
FROM inside GROUP BY record_id, event_id HAVING count(*) > 5""",
    "dwell_runs": f"{BASE} SELECT record_id, event_id, run_start, state, run_len FROM runs",
    "dwell_runs_kept_events": f"""{BASE}, k AS (
  SELECT *, sum(run_len) OVER (PARTITION BY record_id, event_id) AS total FROM runs)
SELECT record_id, event_id, run_start, state, run_len FROM k WHERE total > 5""",
    "event_features": f"{EVENTS} SELECT record_id, event_id, {feature_list(FEATURES_13)} FROM ev",
    "event_features_lineitem": f"""WITH {SIG_LINEITEM}, {RUNS}, {FEATURES}
SELECT record_id, event_id, {feature_list(FEATURES_13)} FROM ev""",
    "record_features_mean": f"{EVENTS}, {record_stats('mean')} SELECT record_id, {r6(*RECORD_NAMES)} FROM rec",
    "record_features_first": f"{EVENTS}, {record_stats('first')} SELECT record_id, {r6(*RECORD_NAMES)} FROM rec",
    "event_features_20": f"""{EVENTS}, {record_stats('mean')}
SELECT record_id, event_id, {feature_list(FEATURES_20)} FROM ev JOIN rec USING (record_id)""",
    "downsample_by_class": f"""{EVENTS}, {ranked('label', '42')}
SELECT record_id, event_id, label FROM ranked WHERE rn <= floor(n * {FRACTION_CASE})""",
    "stratified_split": f"{SPLIT} SELECT record_id, event_id, label, is_test FROM split",
    "validation_split": f"""{SPLIT}, later AS (
  SELECT record_id, event_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {drawn("record_id, event_id", "val")}, record_id, event_id) AS rn FROM split WHERE NOT is_test)
SELECT record_id, event_id, rn > floor(n * {d(0.8)}) AS is_validation FROM later""",
    "mixture_sample": f"WITH gated AS (SELECT vec_id AS id FROM embeddings), {DRAWN} SELECT id, label FROM drawn",
    "shuffled_events": f"{EVENTS} SELECT record_id, event_id, label FROM ev",
    "shuffle_column": f"""{EVENTS}, t AS (
  SELECT record_id, event_id,
         row_number() OVER (ORDER BY {drawn("record_id, event_id", "perm-to")}, record_id, event_id) AS place FROM ev),
g AS (SELECT avg_dwell_0,
        row_number() OVER (ORDER BY {drawn("record_id, event_id", "perm-from")}, record_id, event_id) AS place FROM ev)
SELECT record_id, event_id, {r6("avg_dwell_0")} FROM t JOIN g USING (place)""",
    "class_distribution": f"{EVENTS} SELECT label, count(*) AS n FROM ev GROUP BY label",
    "class_names": f"""{EVENTS} SELECT 'Peptide' || substr('ABCDEFG', label + 1, 1) AS name, label, count(*) AS n
FROM ev GROUP BY label""",
    "max_sequence_length": f"{SPLIT} SELECT max(event_duration) AS max_length FROM split WHERE NOT is_test",
    "pad_sequences": padded_sql("states[1:l]"),
    "pad_sequences_tail": padded_sql("states[greatest(len(states) - l, 0) + 1:]"),
    "one_hot": f"""{EVENTS} SELECT record_id, event_id,
  array_to_string([CASE WHEN x = label THEN 1 ELSE 0 END FOR x IN range({N_CLASSES})], ',') AS one_hot FROM ev""",
    "standardize_fit": f"{EVENTS} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) + 0.0 AS mean, round(stddev_pop({f}), 6) + 0.0 AS std FROM ev"
        for f in FEATURES_12
    ),
    "standardize_apply": f"{EVENTS} SELECT record_id, event_id, " + ", ".join(
        f"round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1.0 "
        f"ELSE stddev_pop({f}) OVER () END, 6) + 0.0 AS {f}"
        for f in FEATURES_12
    ) + " FROM ev",
    "nan_audit": f"{EVENTS} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL OR isnan(CAST({f} AS DOUBLE))) AS n_nan, "
        f"count(*) FILTER (WHERE {f} IS NULL OR isnan(CAST({f} AS DOUBLE))) > 0 AS has_nan FROM ev"
        for f in FEATURES_13
    ),
    "argmax_class": f"WITH {SCORES} SELECT id, label, best AS pred FROM preds",
    "confidence_gate": f"WITH {SCORES} SELECT id, label, pred, 'class_' || pred AS pred_name FROM gated",
    "confusion_matrix": f"WITH {SCORES}, {CELLS} SELECT label, pred, n FROM cells",
    "confusion_matrix_wide": f"WITH {SCORES}, {CELLS} SELECT label, " + ", ".join(
        f"CAST(sum(CASE WHEN pred = {j} THEN n ELSE 0 END) AS BIGINT) AS pred_{j}" for j in range(SCORE_CLASSES)
    ) + " FROM cells GROUP BY label",
    "classification_report": f"""WITH {SCORES}, {CELLS}, {PER_CLASS}, {REPORT}
SELECT label, support, {r6("precision", "recall", "f1")} FROM report""",
    "macro_metrics": f"""WITH {SCORES}, {CELLS}, {PER_CLASS}, m AS (
  SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
         avg(f1) AS macro_f1 FROM per_class WHERE support > 0 OR predicted > 0)
SELECT {r6("accuracy", "macro_precision", "macro_recall", "macro_f1")} FROM m""",
    "binary_metrics": f"""WITH c AS (
  SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
         count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn
  FROM labels), m AS (SELECT *, {RATES} FROM c)
SELECT tp, fp, tn, fn, {r6(*RATE_NAMES)} FROM m""",
    "threshold_sweep": f"""WITH {BINARY_SCORES}, t AS (SELECT unnest([{", ".join(d(t) for t in THRESHOLDS)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score > threshold) AS tp,
        count(*) FILTER (WHERE label = 0 AND score > threshold) AS fp,
        count(*) FILTER (WHERE label = 0 AND score <= threshold) AS tn,
        count(*) FILTER (WHERE label = 1 AND score <= threshold) AS fn FROM bs CROSS JOIN t GROUP BY threshold),
m AS (SELECT *, {RATES} FROM c)
SELECT tp, fp, tn, fn, {r6("threshold", *RATE_NAMES)} FROM m""",
    "accuracy": f"""WITH {SCORES}
SELECT round(avg(CASE WHEN label = best THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM preds""",
    "roc_curve": f"""WITH {BINARY_SCORES}, g AS (
  SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM bs GROUP BY score),
c AS (SELECT score AS threshold,
        sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / CAST(sum(neg) OVER () AS DOUBLE) AS fpr,
        sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / CAST(sum(pos) OVER () AS DOUBLE) AS tpr FROM g)
SELECT {r6("threshold", "fpr", "tpr")} FROM c
UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    "roc_auc": f"""WITH {BINARY_SCORES}, g AS (
  SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM bs GROUP BY score),
c AS (SELECT score,
        sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / CAST(sum(neg) OVER () AS DOUBLE) AS fpr,
        sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / CAST(sum(pos) OVER () AS DOUBLE) AS tpr FROM g),
s AS (SELECT fpr - coalesce(lag(fpr) OVER w, 0.0) AS dx, (tpr + coalesce(lag(tpr) OVER w, 0.0)) / 2 AS y
      FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(dx * y), 6) + 0.0 AS auc FROM s""",
    "vote_counts": f"WITH {SCORES}, {VOTES} SELECT stream, pred, n FROM vc",
    "vote_pattern": f"""WITH {SCORES}, {pattern("log2", STRICT_RANK)}
SELECT stream, label, winner, top1, rank, total_votes, {r6("confidence", "entropy")} FROM patterns""",
    "vote_pattern_voted": f"""WITH {SCORES}, {pattern("ln", VOTED_RANK)}
SELECT stream, label, winner, top1, total_votes,
  CASE WHEN (SELECT n FROM vc WHERE vc.stream = patterns.stream AND vc.pred = label) > 0 THEN rank END AS rank, {r6("confidence", "entropy")} FROM patterns""",
    "vote_summary": f"""WITH {SCORES}, {pattern("log2", STRICT_RANK)}, s AS (
  SELECT avg(top1) AS mean_top1, avg(confidence) AS mean_confidence, avg(entropy) AS mean_entropy,
         avg(rank) AS mean_rank FROM patterns)
SELECT {r6("mean_top1", "mean_confidence", "mean_entropy", "mean_rank")} FROM s""",
    "predicted_fractions": f"""WITH {SCORES}, c AS (SELECT pred AS label, count(*) AS n FROM gated
  WHERE pred IS NOT NULL GROUP BY pred), f AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS fraction FROM c)
SELECT label, n, {r6("fraction")} FROM f""",
    "mixture_fractions": f"""WITH {SCORES}, {MIXED}
SELECT label, {r6("actual", "predicted")} FROM mixed WHERE actual > 0 OR predicted > 0""",
    "mixture_error": f"""WITH {SCORES}, {MIXED}, e AS (
  SELECT avg(abs(predicted - actual)) AS mae, avg((predicted - actual) * (predicted - actual)) AS mse,
         sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse FROM mixed WHERE actual > 0)
SELECT {r6("mae", "mse", "rmse")} FROM e""",
    "mixture_error_union": f"""WITH {SCORES}, {MIXED}, e AS (
  SELECT avg(abs(predicted - actual)) AS mae, avg((predicted - actual) * (predicted - actual)) AS mse,
         sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse
  FROM mixed WHERE actual > 0 OR predicted > 0)
SELECT {r6("mae", "mse", "rmse")} FROM e""",
    "mixture_compare": f"""WITH {SCORES}, {MIXED}, spec AS (
  {" UNION ALL ".join(f"SELECT '{n}' AS name, {d(f)} AS defined" for n, f in MIXTURE_NAMES.items())}),
p AS (SELECT 'class_' || label AS name, predicted FROM mixed WHERE predicted > 0),
j AS (SELECT coalesce(spec.name, p.name) AS name, coalesce(defined, 0.0) AS defined,
             coalesce(predicted, 0.0) AS predicted FROM spec FULL JOIN p ON spec.name = p.name)
SELECT name, {r6("defined", "predicted")} FROM j""",
    "feature_percentiles": f"{EVENTS}, {LONG}, {PCT} SELECT label, feature, {r6('p05', 'p95')} FROM pct",
    "axis_bounds": f"""{EVENTS}, {LONG}, {PCT}, {PAIR_TABLE}, b AS (
  SELECT first, second, feature, min(p05) * {d(0.9)} AS axis_low, max(p95) * {d(1.1)} AS axis_high
  FROM pairs p JOIN pct ON pct.label IN (p.first, p.second) GROUP BY first, second, feature)
SELECT first, second, feature, {r6("axis_low", "axis_high")} FROM b""",
    "feature_histogram": histogram("SELECT * FROM span"),
    "feature_histogram_pooled": histogram(
        "SELECT label, feature, min(lo) OVER (PARTITION BY feature) AS lo, max(hi) OVER (PARTITION BY feature) AS hi FROM span"
    ),
    "bhattacharyya": f"{overlapping('first')} SELECT first, second, feature, {r6('coefficient', 'distance')} FROM result",
    "overlap_area": f"""{overlapping('first')}
SELECT first, second, feature, {r6("mass_1", "mass_2", "overlap_area")} FROM result""",
    "overlap_pooled_edges": f"""{overlapping('pooled')}
SELECT first, second, feature, {r6("mass_1", "mass_2", "coefficient", "overlap_area", "distance")} FROM result""",
    "dwell_histogram": f"{DWELLS} SELECT label, kind, length, n FROM hist",
    "dwell_cdf": f"""{CDF} SELECT label, kind, n, total, {r6("t", "p_first", "p_last", "p_mean")} FROM p""",
    "dwell_fit_single": f"""{CDF}, {fitted(64)}
SELECT k.label, k.kind, CAST(sum(n) AS BIGINT) AS n_dwells, round(lo, 2) AS k1,
       round(sum(n * (p_mean - 1 + exp(-lo * t)) * (p_mean - 1 + exp(-lo * t))), 4) AS rss
FROM k64 k JOIN p ON p.label = k.label AND p.kind = k.kind GROUP BY k.label, k.kind, lo""",
    "kinetics_report_single": f"""{CDF}, {fitted(64)}, pr AS (
  SELECT CAST(record_id % 7 AS INTEGER) AS label, count(*) FILTER (WHERE state = 0) / count(*)::DOUBLE AS probability_0
  FROM inside GROUP BY 1)
SELECT k64.label, round(max(CASE WHEN kind = 'state_0' THEN lo END), 2) AS k_state_0,
  round(max(CASE WHEN kind = 'state_1' THEN lo END), 2) AS k_state_1,
  round(max(CASE WHEN kind = 'event' THEN lo END), 2) AS k_overall,
  round(any_value(probability_0), 6) AS probability_0, round(1 - any_value(probability_0), 6) AS probability_1
FROM k64 JOIN pr ON pr.label = k64.label GROUP BY k64.label""",
    "dwell_cdf_points": f"""{DWELLS}, c AS (
  SELECT label, kind, length * {d(0.001)} AS t,
    row_number() OVER (PARTITION BY label, kind ORDER BY length)
      / CAST(count(*) OVER (PARTITION BY label, kind) AS DOUBLE) AS p FROM dwell)
SELECT label, kind, {r6("t", "p")} FROM c""",
    "state_probability": f"""{BASE}, c AS (
  SELECT CAST(record_id % 7 AS INTEGER) AS label, sum(CASE WHEN state = 0 THEN run_len ELSE 0 END) AS n0,
         CAST(sum(run_len) AS DOUBLE) AS n FROM runs GROUP BY 1),
p AS (SELECT label, n0 / n AS probability_0, (n - n0) / n AS probability_1 FROM c)
SELECT label, {r6("probability_0", "probability_1")} FROM p""",
}
ORACLES["stream_segment_events"] = ORACLES["event_features"]
ORACLES |= {
    "event_patterns": f"""{EVENTS}, {PATTERNS} SELECT record_id, event_id, event_duration, pattern, n
FROM pats JOIN ev USING (record_id, event_id)""",
    "group_split": f"{KINETIC} SELECT record_id, event_id, label, is_test FROM kin",
    "event_model_selection": f"{SELECTION} SELECT candidate, {r6('macro_f1')} FROM macro",
    "train_event_classifier": f"{SELECTION}, "
    + ", ".join(bayes(f"t_{c}", FITTED, TEST, *how) for c, how in CANDIDATES.items())
    + ", told AS ("
    + " UNION ALL ".join(
        f"SELECT label, best FROM t_{c}_pred WHERE (SELECT candidate FROM chosen) = '{c}'" for c in CANDIDATES
    )
    + f"""), {class_cells("SELECT * FROM told", 7)}, {PER_CLASS}, {REPORT}
SELECT label, support, {r6("precision", "recall", "f1")} FROM report""",
    "event_probabilities": f"""{KINETIC}, {PATTERNS}, {bayes("b", NOT_TEST, TEST, FEATURES_12, True)},
every AS (SELECT p.record_id, p.event_id, CAST(best AS INTEGER) AS pred, c.cls FROM b_pred p
          CROSS JOIN (SELECT CAST(range AS INTEGER) AS cls FROM range(7)) c),
e AS (SELECT every.*, coalesce(exp(s - max(s) OVER (PARTITION BY record_id, event_id)), 0.0) AS w
      FROM every LEFT JOIN b_log USING (record_id, event_id, cls))
SELECT record_id, event_id, pred, cls AS class, round(w / sum(w) OVER (PARTITION BY record_id, event_id), 4) + 0.0 AS prob FROM e""",
    "stream_votes": f"""{KINETIC}, {bayes("b", NOT_TEST, TEST, FEATURES_12, False)},
ids AS (SELECT CAST(range AS INTEGER) AS i FROM range(7)),
streams AS (SELECT DISTINCT record_id, label FROM b_pred),
vc AS (SELECT s.record_id, s.label, i AS pred, count(p.best) AS n FROM streams s CROSS JOIN ids
       LEFT JOIN b_pred p ON p.record_id = s.record_id AND p.best = i GROUP BY s.record_id, s.label, i),
tot AS (SELECT record_id, label, CAST(sum(n) AS BIGINT) AS total_votes, max(n) AS top, arg_min(pred, (-n, pred)) AS winner,
               max(CASE WHEN pred = label THEN n END) AS own FROM vc GROUP BY record_id, label),
out AS (SELECT t.*, CASE WHEN winner = label THEN 1 ELSE 0 END AS top1, top / total_votes::DOUBLE AS confidence,
    (SELECT sum(CASE WHEN n > 0 THEN -(n / total_votes::DOUBLE) * log2(n / total_votes::DOUBLE) ELSE 0.0 END)
     FROM vc WHERE vc.record_id = t.record_id) AS entropy,
    (SELECT CAST(count(*) + 1 AS INTEGER) FROM vc WHERE vc.record_id = t.record_id AND n > t.own) AS rank FROM tot t)
SELECT record_id, label, winner, top1, rank, total_votes, {r6("confidence", "entropy")} FROM out""",
    "permutation_importance": f"""{KINETIC}, {bayes("b", NOT_TEST, TEST, FEATURES_13, False)},
takers AS (SELECT record_id, event_id, row_number() OVER (ORDER BY {drawn("record_id, event_id", "importance-to")}, record_id, event_id) AS place
           FROM ({TEST})),
givers AS (SELECT record_id AS r, event_id AS e, row_number() OVER (ORDER BY {drawn("record_id, event_id", "importance-from")}, record_id, event_id)
           AS place FROM ({TEST})),
terms AS (
  SELECT o.record_id, o.event_id, o.label, m.cls, o.f,
    -0.5 * ln(2 * pi() * v) - (o.x - mean) * (o.x - mean) / (2 * v) AS own,
    -0.5 * ln(2 * pi() * v) - (g.x - mean) * (g.x - mean) / (2 * v) AS given
  FROM b_rows o JOIN takers t USING (record_id, event_id) JOIN givers USING (place)
  JOIN b_rows g ON g.record_id = givers.r AND g.event_id = givers.e AND g.f = o.f
  JOIN b_moments m ON m.f = o.f),
slots AS (SELECT unnest([{", ".join(f"'{f}'" for f in ("", *FEATURES_13))}]) AS slot),
best AS (
  SELECT slot, record_id, event_id, label, arg_min(cls, (-s, cls)) AS best FROM (
    SELECT slot, record_id, event_id, label, cls, any_value(q.p) + sum(CASE WHEN f = slot THEN given ELSE own END) AS s
    FROM terms CROSS JOIN slots JOIN b_prior q USING (cls) GROUP BY slot, record_id, event_id, label, cls)
  GROUP BY slot, record_id, event_id, label),
hits AS (
  SELECT slot, cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT slot, label AS cls, 1 AS support, 0 AS predicted, CASE WHEN label = best THEN 1 ELSE 0 END AS tp FROM best
    UNION ALL SELECT slot, best, 0, 1, 0 FROM best) GROUP BY ALL),
f1 AS (SELECT slot, avg(2 * tp / (support + predicted)::DOUBLE) AS f1 FROM hits GROUP BY slot),
out AS (SELECT slot AS feature, (SELECT f1 FROM f1 WHERE slot = '') AS baseline_f1, f1 AS shuffled_f1,
               (SELECT f1 FROM f1 WHERE slot = '') - f1 AS importance FROM f1 WHERE slot <> '')
SELECT feature, {r6("baseline_f1", "shuffled_f1", "importance")} FROM out""",
    "train_state_classifier": f"""{state_model("state", 3)}, {class_cells("SELECT label, best FROM scored", 3)}
SELECT label, pred, n FROM cells""",
    "train_state_classifier_binary": f"""{state_model("CASE WHEN state > 0 THEN 1 ELSE 0 END", 2)},
t AS (SELECT unnest([{", ".join(d(t) for t in (0.3, 0.4, 0.5, 0.6, 0.7))}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND probs[2] > threshold) AS tp,
        count(*) FILTER (WHERE label = 0 AND probs[2] > threshold) AS fp,
        count(*) FILTER (WHERE label = 0 AND probs[2] <= threshold) AS tn,
        count(*) FILTER (WHERE label = 1 AND probs[2] <= threshold) AS fn FROM scored CROSS JOIN t GROUP BY threshold),
m AS (SELECT *, {RATES} FROM c)
SELECT tp, fp, tn, fn, {r6("threshold", *RATE_NAMES)} FROM m""",
    "predicted_states_to_events": f"""{state_model("state", 3)}, sig AS (SELECT record_id, sample_idx, best AS state FROM scored),
{RUNS}, {FEATURES} SELECT record_id, event_id, {feature_list(FEATURES_13)} FROM ev""",
}
# What has gone through files is what it was.
ORACLES["csv_round_trip"] = ORACLES["event_features"]
ORACLES["signal_round_trip"] = ORACLES["dwell_runs"]
ORACLES["event_model_round_trip"] = ORACLES["event_probabilities"]
ORACLES["event_set_round_trip"] = ORACLES["standardize_apply"].removesuffix(" FROM ev") + ", label FROM ev"
