"""Registered queries: each operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.operators import (
    bayes,
    features,
    histogram,
    kinetics,
    metrics,
    models,
    overlap,
    patterns,
    sampling,
    scaling,
    segment,
    signal,
    votes,
)
from dwellkit.operators.sampling import EVENT_ID
from dwellkit.session import shared_dir
from dwellkit.sources import recordings, tables
from dwellkit.sources.tables import CLASS_NAMES, SCORE_CLASSES
from dwellkit.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCORE_NAMES = [f"class_{i}" for i in range(SCORE_CLASSES)]
N_CLASSES = len(CLASS_NAMES)
# Class pairs, downsampling fractions and mixture of the worked examples.
PAIRS = [(0, 2), (2, 3)]
DOWNSAMPLE = [x * 0.80 for x in [0.6163, 0.4340, 0.4446, 0.5652, 0.6163, 0.8829, 1.0000]]
MIXTURE = {0: 0.6, 3: 0.4}
MIXTURE_NAMES = {SCORE_NAMES[k]: f for k, f in MIXTURE.items()}
MIXTURE_TOTAL = 50
#: Places in a row of a padded sequence; small, so that events have several rows here too.
PAD_PART = 32
WINDOW = (0.010, 0.030)
CONFIDENCE = 0.20
N_GROUPS = N_CLASSES * len(features.FEATURES_10)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed precision, so that the order of a sum does not show."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def text(states: Column) -> Column:
    return F.concat_ws(",", F.transform(states, lambda s: s.cast("int").cast("string")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signal_from_events(spark, sf_dir)


def record_label() -> Column:
    return tables.label_of(F.col("record_id"))


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.event_features(samples(spark, sf_dir)).withColumn("label", record_label())


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back, where several jobs follow."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def event_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled event set as a table: what samples, splits and distributions read
    several times is segmented once."""
    return stored(labelled_events(spark, sf_dir), "events")


def long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.long_features(event_set(spark, sf_dir))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.gate(tables.scores_from_embeddings(spark, sf_dir), CONFIDENCE, names=SCORE_NAMES)


def gated_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample drawn by the mixture's spec, then scored and gated."""
    vectors = tables.labelled_vectors(spark, sf_dir)
    drawn = sampling.mixture_sample(vectors, MIXTURE, MIXTURE_TOTAL, ids=["id"])
    return votes.gate(tables.class_scores(drawn, vectors), CONFIDENCE, names=SCORE_NAMES)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.predict(tables.scores_from_embeddings(spark, sf_dir))


# Samples


@query("signal_time_window")
def _(spark, sf):
    return rounded(signal.time_window(samples(spark, sf), *WINDOW).drop("chunk"))


@query("signal_sample_range")
def _(spark, sf):
    return rounded(signal.sample_range(samples(spark, sf), 20, 50).drop("chunk"))


@query("signal_preview")
def _(spark, sf):
    return rounded(signal.preview(samples(spark, sf)).drop("chunk"))


@query("signal_minmax_scaled")
def _(spark, sf):
    return rounded(signal.minmax_scaled(samples(spark, sf)).select("record_id", "sample_idx", "scaled"))


@query("signal_nonzero_moments")
def _(spark, sf):
    return rounded(signal.nonzero_moments(samples(spark, sf)))


@query("signal_smooth3")
def _(spark, sf):
    return rounded(signal.smooth(samples(spark, sf)).select("record_id", "sample_idx", "smoothed"))


@query("signal_smooth3_median")
def _(spark, sf):
    return rounded(signal.smooth(samples(spark, sf), how="median").select("record_id", "sample_idx", "smoothed"))


@query("state_distribution")
def _(spark, sf):
    return rounded(signal.state_distribution(samples(spark, sf), ["record_id"]))


@query("state_recode_binary")
def _(spark, sf):
    return (
        signal.recode_binary(samples(spark, sf))
        .groupBy("record_id", "binary_state")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("number_of_states")
def _(spark, sf):
    return signal.number_of_states(samples(spark, sf))


@query("species_lookup")
def _(spark, sf):
    return (
        signal.apply_species(tables.species_signal(spark, sf))
        .groupBy("species", "state", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("transition_matrix")
def _(spark, sf):
    return rounded(signal.transition_matrix(samples(spark, sf)))


# Events and dwells


@query("segment_events")
def _(spark, sf):
    """Events with their states as runs, in parts counted from the event's start."""
    parts = segment.run_parts(samples(spark, sf))
    coded = F.transform("runs", lambda r: F.concat(r["state"].cast("string"), F.lit("x"), r["run_len"].cast("string")))
    return parts.select("record_id", "event_id", "part", "event_duration", F.concat_ws(",", coded).alias("runs"))


@query("event_bounds")
def _(spark, sf):
    return segment.events(samples(spark, sf))


@query("dwell_runs")
def _(spark, sf):
    return segment.runs(samples(spark, sf))


@query("dwell_runs_kept_events")
def _(spark, sf):
    return segment.runs(samples(spark, sf), min_event_length=5)


@query("event_features")
def _(spark, sf):
    return rounded(features.event_features(samples(spark, sf)).select("record_id", "event_id", *features.FEATURES_13))


@query("event_features_lineitem")
def _(spark, sf):
    events = features.event_features(tables.signal_from_lineitem(spark, sf))
    return rounded(events.select("record_id", "event_id", *features.FEATURES_13))


@query("record_features_mean")
def _(spark, sf):
    return rounded(features.record_features(features.event_features(samples(spark, sf)), "mean"))


@query("record_features_first")
def _(spark, sf):
    return rounded(features.record_features(features.event_features(samples(spark, sf)), "first"))


@query("event_features_20")
def _(spark, sf):
    full = features.with_record_features(event_set(spark, sf))
    return rounded(full.select("record_id", "event_id", *features.FEATURES_20))


# Sampling, splits, encodings


@query("downsample_by_class")
def _(spark, sf):
    kept = sampling.downsample(event_set(spark, sf), DOWNSAMPLE, CLASS_NAMES)
    return kept.select("record_id", "event_id", "label")


@query("stratified_split")
def _(spark, sf):
    split = sampling.stratified_split(event_set(spark, sf), n_classes=N_CLASSES)
    return split.select("record_id", "event_id", "label", "is_test")


@query("validation_split")
def _(spark, sf):
    """The validation rows lie inside the training rows."""
    train = sampling.stratified_split(event_set(spark, sf), n_classes=N_CLASSES).filter(~F.col("is_test"))
    return sampling.validation_split(train).select("record_id", "event_id", "is_validation")


@query("mixture_sample")
def _(spark, sf):
    vectors = tables.labelled_vectors(spark, sf)
    return sampling.mixture_sample(vectors, MIXTURE, MIXTURE_TOTAL, ids=["id"]).select("id", "label")


@query("shuffled_events")
def _(spark, sf):
    return sampling.shuffled(labelled_events(spark, sf)).select("record_id", "event_id", "label")


@query("shuffle_column")
def _(spark, sf):
    shuffled = sampling.permute_column(event_set(spark, sf), "avg_dwell_0")
    return rounded(shuffled.select("record_id", "event_id", "avg_dwell_0"))


@query("class_distribution")
def _(spark, sf):
    return sampling.class_distribution(labelled_events(spark, sf))


@query("class_names")
def _(spark, sf):
    """Label to name and back, with the number of events."""
    named = votes.label_names(labelled_events(spark, sf).drop("name"), CLASS_NAMES).drop("label")
    coded = votes.name_labels(named, {name: i for i, name in enumerate(CLASS_NAMES)})
    return coded.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"))


@query("max_sequence_length")
def _(spark, sf):
    split = sampling.stratified_split(event_set(spark, sf), n_classes=N_CLASSES)
    return sampling.max_sequence_length(split.filter(~F.col("is_test")))


def _padded(spark, sf, keep):
    """Padded to the longest training event; longer test events are cut."""
    split = sampling.stratified_split(event_set(spark, sf), n_classes=N_CLASSES)
    longest = sampling.max_sequence_length(split.filter(~F.col("is_test"))).scalar()
    padded = sampling.pad_parts(segment.state_parts(samples(spark, sf)), longest, keep, part_states=PAD_PART)
    return padded.select("record_id", "event_id", "part", text(F.col("padded")).alias("padded"))


@query("pad_sequences")
def _(spark, sf):
    return _padded(spark, sf, "head")


@query("pad_sequences_tail")
def _(spark, sf):
    return _padded(spark, sf, "tail")


@query("one_hot")
def _(spark, sf):
    coded = sampling.encode_labels(labelled_events(spark, sf), N_CLASSES)
    return coded.select("record_id", "event_id", text(F.col("one_hot")).alias("one_hot"))


@query("standardize_fit")
def _(spark, sf):
    return rounded(scaling.fit_standard(labelled_events(spark, sf), features.FEATURES_12))


@query("standardize_apply")
def _(spark, sf):
    events = event_set(spark, sf)
    scaler = scaling.fit_standard(events, features.FEATURES_12)
    return rounded(
        scaling.apply_standard(events, scaler, features.FEATURES_12).select(
            "record_id", "event_id", *features.FEATURES_12
        )
    )


@query("nan_audit")
def _(spark, sf):
    return sampling.nan_audit(labelled_events(spark, sf), features.FEATURES_13)


# Predictions and metrics


@query("argmax_class")
def _(spark, sf):
    return predicted(spark, sf).select("id", "label", "pred")


@query("confidence_gate")
def _(spark, sf):
    return gated(spark, sf).select("id", "label", "pred", "pred_name")


@query("confusion_matrix")
def _(spark, sf):
    return metrics.confusion(predicted(spark, sf), SCORE_CLASSES)


@query("confusion_matrix_wide")
def _(spark, sf):
    return metrics.confusion_wide(metrics.confusion(predicted(spark, sf), SCORE_CLASSES), SCORE_CLASSES)


@query("classification_report")
def _(spark, sf):
    return rounded(metrics.classification_report(metrics.confusion(predicted(spark, sf), SCORE_CLASSES)))


@query("macro_metrics")
def _(spark, sf):
    return rounded(metrics.macro_metrics(metrics.confusion(predicted(spark, sf), SCORE_CLASSES)))


@query("binary_metrics")
def _(spark, sf):
    return rounded(metrics.binary_metrics(tables.binary_predictions(spark, sf)))


@query("threshold_sweep")
def _(spark, sf):
    return rounded(metrics.threshold_sweep(tables.binary_scores(spark, sf)))


@query("accuracy")
def _(spark, sf):
    return rounded(metrics.accuracy(predicted(spark, sf)))


@query("roc_curve")
def _(spark, sf):
    return rounded(metrics.roc_curve(tables.binary_scores(spark, sf)))


@query("roc_auc")
def _(spark, sf):
    return rounded(metrics.roc_auc(tables.binary_scores(spark, sf)))


# Votes and mixtures


@query("vote_counts")
def _(spark, sf):
    return votes.vote_counts(predicted(spark, sf).withColumnRenamed("label", "stream"), "stream", SCORE_CLASSES)


def _streams(spark, sf):
    return predicted(spark, sf).withColumn("stream", F.col("label"))


@query("vote_pattern")
def _(spark, sf):
    return rounded(votes.vote_pattern(_streams(spark, sf), "stream", SCORE_CLASSES))


@query("vote_pattern_voted")
def _(spark, sf):
    return rounded(votes.vote_pattern_voted(_streams(spark, sf), "stream", SCORE_CLASSES, unvoted="null"))


@query("vote_summary")
def _(spark, sf):
    return rounded(votes.vote_summary(votes.vote_pattern(_streams(spark, sf), "stream", SCORE_CLASSES)))


@query("predicted_fractions")
def _(spark, sf):
    return rounded(votes.predicted_fractions(gated(spark, sf)))


@query("mixture_fractions")
def _(spark, sf):
    return rounded(votes.mixture_fractions(gated_mixture(spark, sf), SCORE_CLASSES))


@query("mixture_error")
def _(spark, sf):
    return rounded(votes.mixture_error(votes.mixture_fractions(gated_mixture(spark, sf), SCORE_CLASSES)))


@query("mixture_error_union")
def _(spark, sf):
    return rounded(votes.mixture_error(votes.mixture_fractions(gated_mixture(spark, sf), SCORE_CLASSES), over="union"))


@query("mixture_compare")
def _(spark, sf):
    mixed = votes.mixture_fractions(gated_mixture(spark, sf), SCORE_CLASSES)
    return rounded(votes.mixture_compare(mixed, MIXTURE_NAMES, SCORE_NAMES))


# Distributions


@query("feature_percentiles")
def _(spark, sf):
    return rounded(overlap.percentiles(long_values(spark, sf), n_groups=N_GROUPS))


@query("axis_bounds")
def _(spark, sf):
    return rounded(overlap.axis_bounds(overlap.percentiles(long_values(spark, sf), n_groups=N_GROUPS), PAIRS))


@query("feature_histogram")
def _(spark, sf):
    return rounded(overlap.histograms(long_values(spark, sf), n_groups=N_GROUPS))


@query("feature_histogram_pooled")
def _(spark, sf):
    return rounded(overlap.histograms(long_values(spark, sf), edges="pooled", n_groups=N_GROUPS))


def _overlap(spark, sf, edges="first"):
    return overlap.overlap(overlap.pair_histograms(long_values(spark, sf), PAIRS, edges=edges, n_groups=N_GROUPS))


@query("bhattacharyya")
def _(spark, sf):
    return rounded(_overlap(spark, sf).select("first", "second", "feature", "coefficient", "distance"))


@query("overlap_area")
def _(spark, sf):
    return rounded(_overlap(spark, sf).select("first", "second", "feature", "mass_1", "mass_2", "overlap_area"))


@query("overlap_pooled_edges")
def _(spark, sf):
    return rounded(_overlap(spark, sf, "pooled"))


# Kinetics


@query("dwell_histogram")
def _(spark, sf):
    return kinetics.dwell_histogram(samples(spark, sf), record_label())


@query("dwell_cdf")
def _(spark, sf):
    return rounded(kinetics.dwell_cdf(kinetics.dwell_histogram(samples(spark, sf), record_label())))


@query("dwell_cdf_points")
def _(spark, sf):
    cdf = kinetics.dwell_cdf(kinetics.dwell_histogram(samples(spark, sf), record_label()))
    return rounded(kinetics.cdf_points(cdf))


@query("state_probability")
def _(spark, sf):
    return rounded(kinetics.state_probability(samples(spark, sf), record_label()))


def _cdf(spark, sf):
    return kinetics.dwell_cdf(kinetics.dwell_histogram(samples(spark, sf), record_label()))


@query("dwell_fit_single")
def _(spark, sf):
    """Rate constants to the two digits a report shows."""
    fits = kinetics.fit_rates(_cdf(spark, sf))
    return fits.select("label", "kind", "n_dwells", F.round("k1", 2).alias("k1"), F.round("rss", 4).alias("rss"))


@query("dwell_fit_double")
def _(spark, sf):
    return kinetics.fit_rates(_cdf(spark, sf), double=[(6, "state_0")])


@query("kinetics_report")
def _(spark, sf):
    fits = kinetics.fit_rates(_cdf(spark, sf), double=[(6, "state_0")])
    return kinetics.kinetics_report(fits, kinetics.state_probability(samples(spark, sf), record_label()))


@query("kinetics_report_single")
def _(spark, sf):
    report = kinetics.kinetics_report(
        kinetics.fit_rates(_cdf(spark, sf)), kinetics.state_probability(samples(spark, sf), record_label())
    )
    rates = [F.round(c, 2).alias(c) for c in ("k_state_0", "k_state_1", "k_overall")]
    shares = [F.round(c, 6).alias(c) for c in ("probability_0", "probability_1")]
    return report.select("label", *rates, *shares)


# Sources and sinks


@query("csv_round_trip")
def _(spark, sf):
    """Events of the recordings after a way through CSV files, one folder per recording."""
    path = shared_dir(spark, "csv")
    recordings.write_recordings(samples(spark, sf), path)
    back = recordings.read_written(spark, path, "bigint")
    return rounded(features.event_features(back).select("record_id", "event_id", *features.FEATURES_13))


@query("signal_round_trip")
def _(spark, sf):
    """Dwells of the recordings after a way through ordered parquet files."""
    path = shared_dir(spark, "signal")
    recordings.write_signal(samples(spark, sf), path)
    return segment.runs(spark.read.parquet(path))


@query("event_set_round_trip")
def _(spark, sf):
    """The event set from its folders by class, scaled by means and deviations read from storage."""
    path, scaler_path = shared_dir(spark, "events-by-class"), shared_dir(spark, "scaler")
    recordings.write_events(labelled_events(spark, sf), path)
    back = recordings.read_events(spark, path, kind="int")
    scaling.fit_standard(back, features.FEATURES_12).write.parquet(scaler_path)
    scaled = scaling.apply_standard(back, spark.read.parquet(scaler_path), features.FEATURES_12)
    return rounded(scaled.select("record_id", "event_id", "label", *features.FEATURES_12))


@query("event_model_round_trip")
def _(spark, sf):
    """Probabilities of the test events by a model that was saved and loaded."""
    split, path = _split_events(spark, sf), shared_dir(spark, "model")
    bayes.fit(split.filter(~F.col("is_test")), features.FEATURES_12, N_CLASSES, sequence=True).save(path)
    scored = bayes.load(spark, path).score(split.filter("is_test")).select("record_id", "event_id", "pred", "probs")
    return rounded(scored.select("record_id", "event_id", "pred", F.posexplode("probs").alias("class", "prob")), 4)


# Models and streams


SAMPLE_ID = ["record_id", "sample_idx"]


def _split_samples(spark, sf):
    """Noisy currents scaled within their recordings, whole recordings held out."""
    scaled = signal.minmax_scaled(tables.signal_from_lineitem(spark, sf, noisy=True))
    return stored(sampling.group_split(scaled, label=None, ids=SAMPLE_ID), "states")


@query("train_state_classifier")
def _(spark, sf):
    """Three-state classifier; confusion cells of the held-out recordings."""
    split = _split_samples(spark, sf).withColumn("label", F.col("state"))
    model = histogram.fit(split.filter(~F.col("is_test")), 3)
    return metrics.confusion(model.score(split.filter("is_test")), 3)


@query("train_state_classifier_binary")
def _(spark, sf):
    """Closed or open; metrics of the held-out recordings at every threshold."""
    split = signal.recode_binary(_split_samples(spark, sf)).withColumn("label", F.col("binary_state"))
    model = histogram.fit(split.filter(~F.col("is_test")), 2)
    scored = model.score(split.filter("is_test")).withColumn("score", F.col("probs")[1])
    return rounded(metrics.threshold_sweep(scored))


@query("predicted_states_to_events")
def _(spark, sf):
    """Both stages joined: states predicted in the held-out recordings are segmented into
    events with features."""
    split = _split_samples(spark, sf).withColumn("label", F.col("state"))
    model = histogram.fit(split.filter(~F.col("is_test")), 3)
    predicted = models.as_signal(model.score(split.filter("is_test")).drop("is_test"))
    return rounded(features.event_features(predicted).select("record_id", "event_id", *features.FEATURES_13))


def _split_events(spark, sf):
    """Events with features, patterns of their whole state sequences and the kinetic class
    of their recording; whole recordings held out."""
    found = stored(features.event_features(samples(spark, sf)), "features")
    held = patterns.event_patterns(samples(spark, sf)).drop("event_duration")
    labelled = tables.with_kinetic_class(found).join(held, list(EVENT_ID))
    return stored(sampling.group_split(labelled), "events")


@query("event_patterns")
def _(spark, sf):
    """Counts of single states, pairs and triples in every kept event, row by row."""
    held = patterns.event_patterns(samples(spark, sf))
    return held.select("record_id", "event_id", "event_duration", F.explode("patterns").alias("pattern", "n"))


@query("group_split")
def _(spark, sf):
    split = sampling.group_split(tables.with_kinetic_class(event_set(spark, sf)))
    return split.select("record_id", "event_id", "label", "is_test")


#: What the selection chooses from: features alone, patterns alone, both.
CANDIDATES = {
    "features": (features.FEATURES_12, False),
    "patterns": ([], True),
    "both": (features.FEATURES_12, True),
}


def _training(spark, sf):
    split = _split_events(spark, sf)
    train = sampling.validation_split(split.filter(~F.col("is_test")).drop("is_test"))
    return stored(train, "train"), split.filter("is_test")


@query("event_model_selection")
def _(spark, sf):
    """Macro F1 of every candidate on the validation rows, which lie inside the training ones."""
    train, _ = _training(spark, sf)
    return rounded(bayes.select(train, CANDIDATES, N_CLASSES)[2])


@query("train_event_classifier")
def _(spark, sf):
    """The candidate that does best on the validation rows; its report on the test recordings."""
    train, test = _training(spark, sf)
    _, best, _ = bayes.select(train, CANDIDATES, N_CLASSES)
    return rounded(metrics.classification_report(metrics.confusion(best.score(test), N_CLASSES)))


@query("event_probabilities")
def _(spark, sf):
    """Probability of each class for each test event, from features and patterns."""
    split = _split_events(spark, sf)
    trained = bayes.fit(split.filter(~F.col("is_test")), features.FEATURES_12, N_CLASSES, sequence=True)
    scored = trained.score(split.filter("is_test")).select("record_id", "event_id", "pred", "probs")
    return rounded(scored.select("record_id", "event_id", "pred", F.posexplode("probs").alias("class", "prob")), 4)


@query("stream_votes")
def _(spark, sf):
    """Each test recording as a stream: events predicted, votes compared with its class."""
    split = _split_events(spark, sf)
    trained = bayes.fit(split.filter(~F.col("is_test")), features.FEATURES_12, N_CLASSES)
    return rounded(votes.vote_pattern(trained.score(split.filter("is_test")), "record_id", N_CLASSES))


@query("permutation_importance")
def _(spark, sf):
    split = _split_events(spark, sf)
    trained = bayes.fit(split.filter(~F.col("is_test")), features.FEATURES_13, N_CLASSES)
    return rounded(models.permutation_importance(trained, split.filter("is_test")))


@query("stream_segment_events")
def _(spark, sf):
    """The recordings replayed as a stream of files, in four micro-batches."""
    base = shared_dir(spark, "live")
    rows = samples(spark, sf).select("record_id", "sample_idx", "state")
    ends = rows.groupBy("record_id").agg(F.max("sample_idx").alias("end_idx"))
    staged = rows.join(ends, "record_id").select(
        "record_id", "sample_idx", "state", (F.col("sample_idx") == F.col("end_idx")).alias("is_last")
    )
    staged.repartitionByRange(4, "sample_idx").write.parquet(f"{base}/samples")
    replay = (
        spark.readStream.schema("record_id long, sample_idx long, state int, is_last boolean")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{base}/samples")
    )
    live.run_to_end(live.live_events(replay), f"{base}/events", f"{base}/checkpoint")
    events = spark.read.schema(live.OUTPUT).parquet(f"{base}/events")
    return rounded(events.select("record_id", "event_id", *features.FEATURES_13))
