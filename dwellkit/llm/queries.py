"""The dealt operators over the driver's whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.functions.columns import lookup
from dwellkit.llm import (
    bpe_words,
    centroids,
    chat_events,
    line_edit,
    minhash,
    mixing,
    perplexity,
    repair,
    string_svm,
    unit_hash,
    url_cascade,
    whitening,
    winnow,
)
from dwellkit.llm.store import stored
from dwellkit.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
# Host and path rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# First labels of the domains that the block list holds.
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
PREFIXES = ["www", "blog", "m"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_minhash_near_dedup")
def _(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), words=4).drop("first")


@query("op2_line_edit_dedup")
def _(spark, sf):
    """Per document: its lines, how many go, and the digest of the text that stays."""
    out = line_edit.deduplicated(table(spark, sf, "documents"), short=True)
    return out.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def block_list(pages: DataFrame) -> DataFrame:
    """(domain): the domains of the pages whose own label is listed, without host prefixes."""
    host = url_cascade.host_of(F.col("url"))
    domains = pages.select(host.alias("host")).distinct().select(F.explode(url_cascade.suffixes(F.col("host"))).alias("domain"))
    return domains.where(F.substring_index("domain", ".", 1).isin(LISTED_LABELS)).distinct()


@query("op3_url_cascade")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return url_cascade.judge(pages, block_list(pages), RULES).drop("listed")


@query("op4_ngram_perplexity")
def _(spark, sf):
    return perplexity.quality(table(spark, sf, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op5_chat_events")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    messages = chat_events.fold(chat_events.events_of(turns.unionByName(extra)))
    return chat_events.read_back(stored(chat_events.render(messages), "formatted"))


@query("op6_bpe_words")
def _(spark, sf):
    return bpe_words.digests(table(spark, sf, "documents"), TOKENIZER)


@query("op7_unit_hash")
def _(spark, sf):
    """Repeated passages: sentences that repeat, where 20 words or more in a row do."""
    return unit_hash.repeated_units(table(spark, sf, "documents"), min_words=1, min_run_words=20)


@query("op8_repair_ids")
def _(spark, sf):
    path = shared_dir(spark, "token-ids")
    repair.write(table(spark, sf, "documents"), path, TOKENIZER, END_ID)
    return repair.read_digests(repair.read(spark, path), repair.symbols_of(TOKENIZER, END_ID))


@query("op9_winnowing")
def _(spark, sf):
    return winnow.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("spans")


@query("op10_string_kernel_svm")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    held = string_svm.held_out(F.col("doc_id"))
    labels = table(spark, sf, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    # At most TRAINING_ROWS ids go out; only their texts move.
    sample = stored(string_svm.drawn(labels), "toxicity-ids")
    model = string_svm.fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    scores = string_svm.score(docs, model)
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op11_weighted_whitening")
def _(spark, sf):
    """One row per vector and component; a deviation that no long holds is NULL there and whole in deviation_exact."""
    out = whitening.whiten(table(spark, sf, "embeddings"), components=4)
    return out.select(
        "vec_id",
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("deviation").alias("deviation_exact"),
        "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "y"),
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("y.whitened").alias("whitened"),
        F.col("y.explained").alias("explained"),
        "identity_error",
        "deviation_exact",
    )


@query("op12_bernoulli_mixing")
def _(spark, sf):
    rows = stored(mixing.sized(table(spark, sf, "documents")), "sizes")
    plan = mixing.planned(rows, mixing.source_targets(rows))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


@query("op13_drift_clustering")
def _(spark, sf):
    assigned, centres = centroids.cluster(table(spark, sf, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return centroids.with_inertia(assigned, len(centres)).select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        lookup(F.col("cluster"), digests or [""]).alias("centroid_sha256"),
    )


# SQL twins. Words are those of the operators; A-Z alone is lower-cased.
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id,
       r.a = min(r.b) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

ORACLES["op3_url_cascade"] = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), d AS (
  SELECT *, '.' || host AS h FROM p
), f AS (
  SELECT page_id, host, path, CASE
    WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM d
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.])(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)([.]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM f
"""

ORACLES["op5_chat_events"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
    + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op9_winnowing"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest([array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') FOR p IN range(1, len(ws) - least(len(ws), 10) + 2)]) AS win
  FROM i WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))
), m AS (
  SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), h AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM m) GROUP BY doc_id
), c AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(c.n_items, 0) AS n_items,
  sha256(coalesce(c.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op12_bernoulli_mixing"] = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13))
      AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w::DOUBLE, source) AS k,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s
  WINDOW before AS (ORDER BY source_size / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(level, k) AS level FROM p WHERE 2.0::DOUBLE * source_size >= level * w
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, l.level * w) AS target FROM s, l
), r AS (
  SELECT doc_id, size, source_size, target, draw,
    CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def _clustering_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Assignments to all centroids, in full each round."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT row, x, arg_min(c, (far, c)) AS cluster, min(far) AS distance FROM (
    SELECT v.row, v.x, m.c,
      CAST(list_sum(list_transform(range(1, 65), lambda k: (v.x[k] - m.x[k]) * (v.x[k] - m.x[k]))) AS BIGINT) AS far
    FROM v, m{i} m) GROUP BY row, x)"""

    def moved(i: int) -> str:
        return f"""s{i} AS (
  SELECT cluster AS c, k, (t - (t % n + n) % n) // n AS mean FROM (
    SELECT cluster, k, sum(x[k])::HUGEINT AS t, count(*)::HUGEINT AS n
    FROM a{i - 1}, (SELECT unnest(range(1, 65)) AS k) GROUP BY cluster, k)),
m{i} AS MATERIALIZED (
  SELECT o.c, coalesce(n.x, o.x) AS x FROM m{i - 1} o
  LEFT JOIN (SELECT c, list(CAST(mean AS BIGINT) ORDER BY k) AS x FROM s{i} GROUP BY c) n ON n.c = o.c)"""

    steps = ", ".join(f"{assigned(i)}, {moved(i + 1)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = 64
), m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x
  FROM (SELECT x, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) ORDER BY h, x LIMIT {clusters}
), {steps}, {assigned(rounds)}
SELECT v.vec_id, a.cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN m{rounds} m ON m.c = a.cluster
"""


ORACLES["op13_drift_clustering"] = _clustering_sql()
