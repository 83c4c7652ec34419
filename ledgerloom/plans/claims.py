"""Source claims: what captures of a source list, whether claims stand, whom they are about, and what they say of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, dealt

# Claim types, the rule that makes evidence, and statuses that count as a negative decision.
OWNED, ORCID, EMAIL, UNOWNED = "SCOPUS_ID_OWNED", "ORCID_DECLARED", "EMAIL_DECLARED", ("SCOPUS_ID_AMBIGUOUS", "SCOPUS_ID_UNASSIGNED")
RULE, RULE_VERSION = "SOURCE_DECLARED_SCOPUS_ID", "1"
NEGATIVE_CANDIDATE, NEGATIVE_IDENTITY = ("REJECTED", "SUPERSEDED"), ("REJECTED", "REVOKED")

SCOPE = ["source_system", "scope_key", "projection"]
CLAIM = [*SCOPE, "claim_key"]


def problems(observations: DataFrame, captures: DataFrame) -> DataFrame:
    """(code, capture_id): why a set of observations can't be taken: observations of several rule sets, of unknown captures, the same
    claim twice in a capture, a capture with several analyses or without a time."""
    rules = observations.agg(F.countDistinct("rules").alias("n")).where("n > 1").select(F.lit("MIXED_RULE_VERSIONS").alias("code"), F.lit(None).cast("string").alias("capture_id"))
    of = lambda df, code: df.select(F.lit(code).alias("code"), F.col("capture_id").cast("string").alias("capture_id"))
    unknown = observations.select("capture_id").distinct().join(captures, "capture_id", "left_anti")
    twice = observations.groupBy("capture_id", "claim_id").count().where("count > 1").select("capture_id").distinct()
    crowded = observations.groupBy("capture_id").agg(F.countDistinct("analysis_id").alias("n")).where("n > 1")
    timeless = captures.where("captured_at is null")
    return rules.union(of(unknown, "UNKNOWN_CAPTURE")).union(of(twice, "DUPLICATE_OBSERVATION")).union(of(crowded, "MULTIPLE_ANALYSES_PER_CAPTURE")).union(of(timeless, "CAPTURE_TIME_INVALID"))


def scope_ends(captures: DataFrame, scope: list[str], at: str, capture: str) -> DataFrame:
    """(scope, latest, n_latest, all_complete): a scope's last instant, and how many captures it has, and whether all are complete."""
    per = captures.groupBy(*scope, at).agg(F.countDistinct(capture).alias("n_latest"), F.bool_and("complete").alias("all_complete"))
    return per.groupBy(*scope).agg(F.max_by(F.struct(F.col(at).alias("latest"), "n_latest", "all_complete"), at).alias("e")).select(*scope, "e.*")


def presence_of(last_seen: Column, hits: Column, seen_complete: Column, weak: Column) -> Column:
    """CURRENT if all captures at the last instant list a claim. WITHDRAWN if none does, all are complete, and a complete one listed it
    last, under a key that isn't weak. Captures at one instant are never ordered."""
    at_end = last_seen == F.col("latest")
    gone = ~weak & (last_seen < F.col("latest")) & F.col("all_complete") & seen_complete
    return F.when(at_end & (hits == F.col("n_latest")), "CURRENT").when(~at_end & gone, "WITHDRAWN").otherwise("NOT_OBSERVED")


def current_claims(observations: DataFrame, captures: DataFrame, refs: bool = True) -> DataFrame:
    """One row a claim of a scope: its last observation's columns, presence, whether captures of its last instant disagree, how many
    observations of it there are, and with refs all of them. Repeated captures and analyses of a claim are one; a claim of another
    source is another.

    A few claims may be listed very often. First each claim's last instant is found, by sums and maxima that need little room; only
    captures of such instants are counted one by one, and the last one's columns are looked up. Only refs are gathered by claim.
    Neither observations nor captures are broadcast, as both grow with the input.
    """
    caps = captures.select("capture_id", *SCOPE, "captured_at", (F.col("completeness") == "COMPLETE").alias("complete"), "completeness")
    # which of the four pairs of flags there are, as bits; a pair with a null doesn't count
    flags = F.when(F.col("is_primary").isNotNull() & F.col("listed").isNotNull(), F.when(F.col("is_primary"), 4).otherwise(1) * F.when(F.col("listed"), 2).otherwise(1))
    at = caps.drop("completeness")
    times = observations.select("capture_id", "claim_key", (F.col("key_strength") == "WEAK").alias("weak")).join(dealt(at.drop("complete")), "capture_id")
    times = cut(times.groupBy(*CLAIM).agg(F.max("captured_at").alias("last_seen"), F.bool_or("weak").alias("weak"), F.count(F.lit(1)).alias("n_observed")))
    ends = times.select(*SCOPE, F.col("last_seen").alias("captured_at")).distinct()
    final = observations.select("capture_id", "claim_key", flags.alias("flags")).join(dealt(at.join(ends, [*SCOPE, "captured_at"], "left_semi")), "capture_id")
    final = final.groupBy(*CLAIM, "captured_at", "capture_id").agg(F.bit_or("flags").alias("flags"), F.bool_or("complete").alias("complete"))
    final = final.groupBy(*CLAIM, F.col("captured_at").alias("last_seen")).agg(
        F.count(F.lit(1)).alias("hits"), F.max("capture_id").alias("last_capture"), F.coalesce(F.bit_count(F.bit_or("flags")), F.lit(0)).alias("n_flags"), F.bool_or("complete").alias("seen_complete")
    )
    one = cut(_with(times, final, [*CLAIM, "last_seen"]))
    last = F.struct("capture_id", "claim_type", "value_raw", "value_normalized", "is_primary", "listed", "record_key", "key_method", "key_strength", "record_source_id", "record_email", "rules")
    asked = one.select(F.col("last_capture").alias("capture_id"), F.col("claim_key").alias("asked_key"))
    found = observations.join(asked, (observations["capture_id"] == asked["capture_id"]) & observations["claim_key"].eqNullSafe(asked["asked_key"]), "left_semi")
    found = found.select("capture_id", "claim_key", last.alias("o")).groupBy(F.col("capture_id").alias("last_capture"), "claim_key").agg(F.first("o").alias("o"))
    y = _with(one, found, ["last_capture", "claim_key"]).join(scope_ends(caps, SCOPE, "captured_at", "capture_id"), SCOPE)
    if refs:
        ref = F.struct("captured_at", "capture_id", "completeness", "analysis_id", "claim_id", "record_id")
        y = _with(y, observations.join(dealt(caps), "capture_id").groupBy(*CLAIM).agg(F.array_sort(F.collect_list(ref)).alias("observed_in")), CLAIM)
    differs = (F.col("last_seen") == F.col("latest")) & (F.col("hits") < F.col("n_latest"))
    doubt = F.when(differs, "PRESENCE_DIFFERS").when(F.col("n_flags") > 1, "FLAGS_DIFFER")
    presence = presence_of(F.col("last_seen"), F.col("hits"), F.col("seen_complete"), F.col("weak"))
    return y.select(*CLAIM, "o.*", presence.alias("presence"), doubt.alias("doubt"), "hits", "n_observed", *["observed_in"] * refs)


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, null where it has no row; null keys are equal."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]), "left").drop(*[f"__{c}" for c in keys])


def _hits(lecturers: DataFrame, key: str, name: str) -> DataFrame:
    return lecturers.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.min("lec_id").alias(f"{name}_lec"), F.countDistinct("lec_id").alias(f"{name}_n"))


def resolve(claims: DataFrame, lecturers: DataFrame) -> DataFrame:
    """claims with resolution and lec_id: by profile address, or else by e-mail; null where the key is weak, several lecturers have it,
    the two disagree, or none has either. lecturers: lec_id, url, email, orcid, all normalised or null."""
    x = claims.join(dealt(_hits(lecturers, "url", "record_source_id")), "record_source_id", "left").join(dealt(_hits(lecturers, "email", "record_email")), "record_email", "left")
    url_n, email_n = F.coalesce("record_source_id_n", F.lit(0)), F.coalesce("record_email_n", F.lit(0))
    other = (email_n > 1) | ((email_n == 1) & (F.col("record_email_lec") != F.col("record_source_id_lec")))
    how = (
        F.when(F.col("key_strength") == "WEAK", "WEAK_SOURCE_KEY").when(url_n > 1, "AMBIGUOUS").when((url_n == 1) & other, "CONFLICT").when(url_n == 1, "RESOLVED_SOURCE_ID")
        .when(email_n > 1, "AMBIGUOUS").when(email_n == 1, "RESOLVED_EMAIL").otherwise("UNRESOLVED")
    )
    lec = F.when(how == "RESOLVED_SOURCE_ID", F.col("record_source_id_lec")).when(how == "RESOLVED_EMAIL", F.col("record_email_lec"))
    return x.select(*claims.columns, how.alias("resolution"), lec.alias("lec_id"))


def bridge(observations: DataFrame, captures: DataFrame, lecturers: DataFrame, authors: DataFrame, refs: bool = True) -> DataFrame:
    """Resolved claims with their author and the lecturer's own data: what evidence() and findings() are made from.

    Run problems() first: its rows say why observations can't be taken. authors: author_id, scopus_id. refs: with each claim's observations.
    """
    known = lecturers.select("lec_id", F.col("email").alias("lec_email"), F.col("orcid").alias("lec_orcid"))
    x = resolve(current_claims(observations, captures, refs), lecturers).join(dealt(known), "lec_id", "left")
    return x.join(dealt(authors.select("author_id", F.col("scopus_id").alias("value_normalized"))), "value_normalized", "left")


def evidence(bridged: DataFrame) -> DataFrame:
    """One row for each claim of an owned ID that is resolved and in the catalog, with the digest of its key as fingerprint."""
    key = F.array(*[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in ("lec_id", "author_id", F.lit(RULE), F.lit(RULE_VERSION), *CLAIM)])
    own = bridged.where((F.col("claim_type") == OWNED) & F.col("lec_id").isNotNull() & F.col("author_id").isNotNull())
    return own.select("lec_id", "author_id", F.col("value_normalized").alias("scopus_id"), *CLAIM, F.sha2(F.to_json(key), 256).alias("fingerprint"), "resolution", F.coalesce("is_primary", F.lit(False)).alias("is_primary"), F.coalesce("listed", F.lit(True)).alias("listed"), "presence", "rules", *[c for c in ("n_observed", "observed_in") if c in bridged.columns])


def _rules(bridged: DataFrame) -> list[Column]:
    """Each a code or null: what a claim gives rise to. A claim that a rule ends isn't looked at by those after it."""
    valued, owned = F.col("value_normalized").isNotNull(), F.col("claim_type") == OWNED
    orcid = F.when(F.col("lec_orcid") == F.col("value_normalized"), "ORCID_DECLARED_MATCHES_LECTURER").when(F.col("lec_orcid").isNotNull(), "ORCID_DECLARED_DIFFERS_FROM_LECTURER").otherwise("ORCID_DECLARED_LECTURER_HAS_NONE")
    mail = (F.col("resolution") == "RESOLVED_SOURCE_ID") & ~F.col("lec_email").eqNullSafe(F.col("value_normalized"))
    return [
        F.when(F.col("doubt").isNotNull(), "CAPTURE_ORDER_AMBIGUOUS"),
        F.when(~valued, "INVALID_CLAIM_VALUE").when(F.col("claim_type").isin(*UNOWNED), "UNOWNED_SCOPUS_ID_LISTED")
        .when((F.col("claim_type") == ORCID) & F.col("lec_id").isNotNull(), orcid).when((F.col("claim_type") == EMAIL) & mail, "EMAIL_DECLARED_DIFFERS_FROM_LECTURER")
        .when(owned & F.col("lec_id").isNull(), F.concat(F.lit("SUBJECT_"), "resolution")).when(owned & F.col("author_id").isNull(), "SCOPUS_AUTHOR_NOT_IN_CATALOG"),
    ]


def findings(bridged: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(code, source_system, scope_key, claim_key, lec_id, scopus_id, detail): what a person should look at.

    pairs: as assess() gives them; approved ones that no source lists any more are findings too.
    """
    x = bridged.select(*bridged.columns, F.explode(F.array_compact(F.array(*_rules(bridged)))).alias("code"))
    detail = F.when(F.col("code") == "CAPTURE_ORDER_AMBIGUOUS", F.concat_ws(":", "doubt", F.col("hits").cast("string"))).when(F.col("code") == "INVALID_CLAIM_VALUE", F.col("value_raw")).when(F.col("code") == "UNOWNED_SCOPUS_ID_LISTED", F.concat_ws(":", "claim_type", F.col("author_id").isNotNull().cast("string"), "presence"))
    ids = F.when(F.col("code").startswith("ORCID") | F.col("code").startswith("EMAIL"), None).otherwise(F.col("value_normalized"))
    of = F.when(F.col("code").isin("CAPTURE_ORDER_AMBIGUOUS", "INVALID_CLAIM_VALUE", "UNOWNED_SCOPUS_ID_LISTED"), None).otherwise(F.col("lec_id"))
    out = x.select("code", "source_system", "scope_key", "claim_key", of.alias("lec_id"), ids.alias("scopus_id"), detail.alias("detail"))
    holders = bridged.where((F.col("claim_type") == ORCID) & F.col("value_normalized").isNotNull()).groupBy("value_normalized").agg(F.countDistinct("source_system", "record_key").alias("n")).where("n > 1")
    none = lambda kind: F.lit(None).cast(kind)
    several = holders.select(F.lit("ORCID_DECLARED_BY_MULTIPLE_RECORDS"), F.lit("*"), F.lit("*"), F.concat(F.lit("ORCID_DECLARED|*|"), "value_normalized"), none("long"), none("string"), F.col("n").cast("string"))
    out = out.union(several)
    if pairs is not None:
        gone = pairs.where((F.col("identity_status") == "APPROVED") & ~F.col("live"))
        out = out.union(gone.select(F.lit("SOURCE_NO_LONGER_LISTS_APPROVED_ID"), "first.source_system", "first.scope_key", "first.claim_key", "lec_id", "scopus_id", none("string")))
    return out


def assess(found: DataFrame, decisions: DataFrame, bridged: DataFrame) -> DataFrame:
    """One row a pair that evidence names: its class, the reasons in a fixed order, fingerprints, and the decision it has, which stays.

    decisions: lec_id, author_id, candidate_status, identity_status, one a pair. bridged gives IDs that a source lists, at present,
    as nobody's or as ambiguous.
    """
    by = found.groupBy("lec_id", "author_id").agg(
        F.min("scopus_id").alias("scopus_id"), F.bool_or(F.col("presence") != "WITHDRAWN").alias("live"), F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"),
        F.min(F.struct(*CLAIM)).alias("first"),
    )
    live = by.where("live").groupBy("author_id").agg(F.countDistinct("lec_id").alias("n_live"))
    approved = decisions.where("identity_status = 'APPROVED'").groupBy("author_id").agg(F.min("lec_id").alias("owner_a"), F.max("lec_id").alias("owner_b"))
    loose = bridged.where(F.col("claim_type").isin(*UNOWNED) & (F.col("presence") == "CURRENT")).groupBy(F.col("value_normalized").alias("scopus_id"))
    loose = loose.agg(F.array_join(F.array_sort(F.collect_set(F.regexp_replace("claim_type", "^SCOPUS_ID_", ""))), "_AND_").alias("also"))
    x = by.join(dealt(decisions), ["lec_id", "author_id"], "left").join(live, "author_id", "left").join(approved, "author_id", "left").join(loose, "scopus_id", "left")
    negative = F.coalesce(F.col("candidate_status").isin(*NEGATIVE_CANDIDATE), F.lit(False)) | F.coalesce(F.col("identity_status").isin(*NEGATIVE_IDENTITY), F.lit(False))
    other = F.coalesce((F.col("owner_a") != F.col("lec_id")) | (F.col("owner_b") != F.col("lec_id")), F.lit(False))
    several, also = F.coalesce(F.col("n_live") > 1, F.lit(False)), F.col("also").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(negative, "PRIOR_NEGATIVE_DECISION_REVIEWER_REOPEN_REQUIRED"), F.when(other, "SCOPUS_ID_APPROVED_FOR_OTHER_LECTURER"), F.when(several, "SCOPUS_ID_DECLARED_FOR_SEVERAL_LECTURERS"),
        F.when(also, F.concat(F.lit("SCOPUS_ID_ALSO_LISTED_AS_"), "also")), F.when(~F.col("live"), "CLAIM_WITHDRAWN_FROM_SOURCE")))
    kind = F.when(F.col("identity_status") == "APPROVED", "VERIFIED_ASSOCIATION").when(other | several | also, "CONFLICTING_EVIDENCE").when(~F.col("live"), "INSUFFICIENT_EVIDENCE").otherwise("PLAUSIBLE_CANDIDATE")
    return x.select("lec_id", "author_id", "scopus_id", kind.alias("class"), reasons.alias("reasons"), "fingerprints", "candidate_status", "identity_status", "live", "first")
