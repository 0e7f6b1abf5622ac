"""Scores, guards and decisions of (source, candidate) pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed thresholds and weights.
ACCEPT, REVIEW, GAP = 0.88, 0.55, 0.08
REMATCH_REVIEW, UNPROVED, RETRY_AFTER = 0.45, 0.87, 10.0
NEAR_MS = 8_000
WEIGHTS = {"title": 0.50, "artist": 0.35, "album": 0.10, "duration": 0.05}


def valid_duration(ms: Column) -> Column:
    return F.coalesce(ms.between(5_000, 3_600_000), F.lit(False))


def duration_similarity(a: Column, b: Column) -> Column:
    """Null if either is missing or implausible."""
    seconds = F.abs(a - b) / 1000.0
    step = F.when(seconds <= 3, 1.0).when(seconds <= 6, 0.9).when(seconds <= NEAR_MS / 1000, 0.4).otherwise(0.0)
    return F.when(valid_duration(a) & valid_duration(b), step)


def duration_conflict(a: Column, b: Column) -> Column:
    seconds, longest = F.abs(a - b) / 1000.0, F.greatest(a, b) / 1000.0
    far = ((seconds >= 20) & (seconds / longest >= 0.08)) | (seconds > 45)
    return valid_duration(a) & valid_duration(b) & far


def version_consistency(a: Column, b: Column, lang_a: Column, lang_b: Column, critical: list[str]) -> Column:
    """Bonus or penalty of two tag arrays. What counts is how many critical tags they share or miss."""
    only = F.array(*[F.lit(t) for t in critical])
    a_, b_ = F.array_intersect(a, only), F.array_intersect(b, only)
    tags = -0.40 * F.size(F.array_except(a_, b_)) - 0.45 * F.size(F.array_except(b_, a_)) + 0.10 * F.size(F.array_intersect(a_, b_))
    langs = F.when(lang_a == lang_b, 0.10).when(lang_a.isNotNull() & lang_b.isNotNull(), -0.50).otherwise(0.0)
    master = F.when(F.array_contains(b, "remaster") & (F.size(a) == 0), 0.02).otherwise(0.0)
    return tags + langs + master


def composite(title: Column, artist: Column, album: Column, duration: Column, has_artist: Column, has_album: Column) -> Column:
    """Weighted mean over what both sides have; without credits 0.7 of the title."""
    w_album = F.when(has_album, WEIGHTS["album"]).otherwise(0.0)
    w_duration = F.when(duration.isNotNull(), WEIGHTS["duration"]).otherwise(0.0)
    total = WEIGHTS["title"] + WEIGHTS["artist"] + w_album + w_duration
    mean = (title * WEIGHTS["title"] + artist * WEIGHTS["artist"] + F.coalesce(album, F.lit(0.0)) * w_album + F.coalesce(duration, F.lit(0.0)) * w_duration) / total
    return F.when(has_artist, mean).otherwise(title * 0.70)


def guarded(score: Column, title: Column, artist: Column, has_artist: Column, title_bad: Column, short_title: Column) -> Column:
    """The score after the hard rules on credit, title and short titles, within 0 and 1."""
    s = F.when(has_artist & (artist < 0.35), score * 0.30).otherwise(score)
    s = F.when(title_bad | (title < 0.45), F.least(s * 0.30, F.lit(0.39))).otherwise(s)
    s = F.when(short_title & (artist < 0.85), s * 0.30).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def confidence(score: Column, critical_conflict: Column) -> Column:
    return F.when(critical_conflict | (score < REVIEW), "low").when(score >= ACCEPT, "exact").when(score >= 0.72, "high").otherwise("medium")


def ranked(pairs: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Adds rank (ties keep ``order``), the next score, and the gap to it, 1 when alone."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    out = pairs.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead(score).over(w))
    return out.withColumn("gap", F.coalesce(F.bround(F.col(score) - F.col("second"), 3), F.lit(1.0)))


def decide(score: Column, gap: Column, second: Column, strong: Column, conflict: Column, title_conflict: Column, artist: Column, title: Column, version: Column, same_work: Column, review_at: float = REVIEW, accept_at: float = ACCEPT, least_gap: float = GAP) -> Column:
    """auto_accept, review or no_match for the best candidate."""
    gap_ok = same_work | F.coalesce(second < 0.65, F.lit(True)) | (gap >= least_gap)
    accept = (score >= accept_at) & strong & ~conflict & (artist >= 0.70) & (title >= 0.80) & (version >= 0) & gap_ok
    return F.when((score < review_at) | title_conflict, "no_match").when(accept, "auto_accept").otherwise("review")


def evidence_level(families: Column, title_definite: Column, identity: Column, one_sided_language: Column) -> Column:
    """strong needs a definite title and an independent identity; a language on one side only leaves medium."""
    n = F.size(F.array_distinct(families))
    return F.when(title_definite & identity & ~one_sided_language, "strong").when(n >= 1, "medium").otherwise("weak")


def code_path(same_code: Column, conflicts: Column, score: Column, title: Column, artist: Column) -> Column:
    """struct(score, level, decision) where codes agree: certain without conflicts, else for review or none; null where they don't.

    With a conflict of titles the score is 0.40 at most; otherwise it lies between 0.65 and 0.95 if the title or the
    credits are half alike, and is 0.40 if neither is.
    """
    clean = F.size(conflicts) == 0
    hard = F.exists(conflicts, lambda c: c.contains("title"))
    capped = F.when(hard, F.least(score, F.lit(0.40))).when((title >= 0.50) | (artist >= 0.50), F.greatest(F.least(score, F.lit(0.95)), F.lit(0.65))).otherwise(F.lit(0.40))
    decision = F.when(clean, "auto_accept").when(hard | (capped < REVIEW), "no_match").otherwise("review")
    return F.when(same_code, F.struct(F.when(clean, 1.0).otherwise(capped).alias("score"), F.when(clean, "strong").otherwise("conflict").alias("level"), decision.alias("decision")))


def status(decision: Column, kinds: Column) -> Column:
    """The search status of a result: its decision, or without any candidate the gravest kind of failure."""
    order = ["auth_failed", "rate_limited", "timeout", "network_error", "upstream_error", "invalid_response"]
    worst = F.get(F.filter(F.array(*[F.lit(k) for k in order]), lambda k: F.array_contains(kinds, k)), F.lit(0))
    return F.when(decision == "auto_accept", "matched").when(decision == "review", "review").otherwise(F.coalesce(worst, F.lit("no_match")))


def length_gate(seconds: Column) -> Column:
    """Whether a video may be a recording: 20 to 900 seconds, or unknown (null or 0)."""
    s = F.coalesce(seconds, F.lit(0))
    return (s == 0) | s.between(20, 900)


def fetch_gate(tier: Column) -> Column:
    """What happens with the best video of a track: the two upper tiers are fetched, others are for a person."""
    return F.when(tier <= 2, "auto").otherwise("manual")


def media_score(tier: Column, plays: Column, seconds: Column) -> Column:
    """The rank score of a video: its tier first, then plays, then a likely length."""
    base = F.element_at(F.array(*[F.lit(x) for x in (1_000_000, 200_000, 30_000, 1_000)]), tier)
    length = F.when(seconds.between(120, 360), 10_000).when((seconds < 60) | (seconds > 600), -30_000).otherwise(0)
    return (base + F.round(F.log10(F.greatest(plays, F.lit(1)) + 10) * 10_000, 3) + length).cast("double")


def families(title: Column, artist: Column, duration: Column, album: Column) -> Column:
    """The kinds of evidence that speak for a pair, in this order."""
    told = F.array(F.when(title >= 0.80, "title"), F.when(artist >= 0.70, "artist"), F.when(duration >= 0.9, "duration"), F.when(album >= 0.85, "album"))
    return F.filter(told, lambda f: f.isNotNull())


def shares_artist(a: Column, b: Column) -> Column:
    """Whether two lists of artist ids have one in common; lists that are missing have none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, in any order and however often."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def strong_identity(score: Column, title: Column, artist: Column, version: Column, conflicts: Column) -> Column:
    """Whether a candidate of another storefront is surely the song itself."""
    return (score >= 0.72) & (title >= 0.75) & (artist >= 0.65) & (version >= 0) & (F.size(conflicts) == 0)


def best_way(ways: Column) -> Column:
    """Of the comparisons (similarity, method, mismatch, unverified) of a title and its other names, in order: the first of 0.95 or more, else the most alike, the first of equal ones.

    Short of 0.95, one of 0.80 or more has no doubt left. Null for an empty list.
    """
    sure = F.try_element_at(F.filter(ways, lambda w: w["similarity"] >= 0.95), F.lit(1))
    most = F.try_element_at(F.filter(ways, lambda w: w["similarity"] == F.array_max(F.transform(ways, lambda v: v["similarity"]))), F.lit(1))
    settled = F.when(most["similarity"] >= 0.80, most.withField("mismatch", F.lit(False)).withField("unverified", F.lit(False))).otherwise(most)
    return F.coalesce(sure, settled)
