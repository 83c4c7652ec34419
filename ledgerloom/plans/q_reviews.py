"""Queries: batches of review commands, journals and captures with state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut
from ..streaming import journal as J
from . import claims as CL
from . import reviews as R
from .base import query
from .q_lists import evidence_counts, latest_observation


# ---------------------------------------------------------------- review commands
def review_world(r):
    """(commands, candidates, observations, users, identities, history): five kinds of commands, groups among them, over the candidates."""
    cand = r.cand.groupBy("lec_id", "author_id").agg(F.min(F.struct("cand_id", "status", "version")).alias("c"))
    cand = cand.select("c.cand_id", "lec_id", "author_id", F.when(F.col("c.status") == "REVOKED", "PENDING").otherwise(F.col("c.status")).alias("status"), F.col("c.version").cast("long").alias("version"))
    latest = latest_observation(r).select(F.col("obs_id").alias("cur"), F.lit(True).alias("is_current"))
    obs = r.obs.select("obs_id", "cand_id").join(latest, F.col("obs_id") == F.col("cur"), "left").join(evidence_counts(r), "obs_id", "left")
    obs = obs.select("obs_id", "cand_id", F.coalesce("is_current", F.lit(False)).alias("is_current"), (F.coalesce("n_pub", F.lit(0)) > 0).alias("has_pub"))
    current = obs.where("is_current").select("cand_id", F.col("obs_id").alias("cur"))
    first = obs.groupBy("cand_id").agg(F.min("obs_id").alias("first"))
    decided = cand.where("status <> 'PENDING'").join(first, "cand_id", "left")
    history = decided.select("cand_id", F.coalesce("first", -F.col("cand_id")).alias("obs_id"), F.when(F.col("status") == "ACCEPTED", "ACCEPT").otherwise("REJECT").alias("action"))
    identities = cand.where("status = 'ACCEPTED'").select("lec_id", "author_id", F.lit("APPROVED").alias("status"))
    identities = identities.union(cand.where("status = 'PENDING' and cand_id % 6 = 0").select("lec_id", "author_id", F.lit("REVOKED")))
    users = r.table("region").selectExpr("cast(r_regionkey as bigint) AS user_id", "CASE WHEN r_regionkey = 4 THEN 'VIEWER' WHEN r_regionkey % 2 = 0 THEN 'ADMIN' ELSE 'REVIEWER' END AS role", "r_regionkey <> 3 AS active")
    ev = r.table("events").selectExpr("event_id", "user_id", "user_id * 9 + event_id % 9 AS cand_id")
    one = ev.where("event_id % 10 <> 0").join(current, "cand_id", "left").join(cand.select("cand_id", F.col("version").alias("v")), "cand_id", "left")
    one = one.selectExpr(
        "event_id AS seq", "0L AS item", "cast(NULL as bigint) AS grp", "element_at(array('ACCEPT', 'ACCEPT', 'REJECT', 'REVOKE', 'REOPEN'), cast(event_id % 5 + 1 as int)) AS action", "cand_id",
        "CASE WHEN event_id % 7 = 0 THEN event_id ELSE coalesce(cur, event_id) END AS obs_id", "coalesce(v, 0) + CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS version",
        "CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END AS user_id", "CASE WHEN event_id % 8 = 1 THEN ' ' ELSE 'seen' END AS reason", "cast(NULL as bigint) AS lecturer", "cast(NULL as boolean) AS is_main",
    )
    asked = ev.where("event_id % 10 = 0").select("event_id", (F.col("user_id") % 350).alias("lec_id"))
    members = asked.join(cand, "lec_id").join(current, "cand_id", "left")
    members = members.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("cand_id"))).where("k <= 3")
    group = members.selectExpr("event_id AS seq", "cast(k as bigint) AS item", "event_id AS grp", "'ACCEPT' AS action", "cand_id", "cur AS obs_id", "version", "0L AS user_id", "CASE WHEN event_id % 70 = 0 THEN NULL ELSE 'one person' END AS reason", "lec_id AS lecturer", "k = 1 AS is_main")
    return one.unionByName(group), cand, obs, users, identities, history


@query("review_batch")
def review_batch(r):
    """Accept, reject, revoke, reopen and group accept in one batch; SQL has no fold over state, so a test holds it against a loop."""
    return R.review_batch(*review_world(r))


# ---------------------------------------------------------------- journals
def journal_commands(r):
    """Proposals, approvals, revocations and replacements of each candidate, some by one person alone, some twice."""
    snapshot = "concat('s', cast(user_id as string), '-', cast({} % 6 as string))"
    x = r.table("events").selectExpr(
        "user_id AS cand_id", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'APPROVE_EXCEPTION' WHEN 'error' THEN 'REVOKE' WHEN 'signup' THEN 'SUPERSEDE' ELSE 'PROPOSE' END AS kind",
        "CASE WHEN event_id % 3 = 0 THEN 'STANDARD' ELSE 'INSTITUTIONAL_EXCEPTION' END AS branch", "concat('u', cast(user_id % 3 as string)) AS actor", "concat('p', cast(user_id % 3 as string)) AS principal",
        "concat('u', cast(event_id % 4 as string)) AS second", "concat('p', cast(event_id % 4 as string)) AS second_principal", f"{snapshot.format('event_id div 7')} AS about", f"{snapshot.format('event_id div 11')} AS by",
        "CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'checked' END AS reason", f"{snapshot.format('event_id')} AS snapshot_hash", "event_id % 3 <> 0 AS risk_acknowledged",
    )
    proposal = lambda c: J.op_key(F.lit(J.PROPOSE), F.col(c))
    x = x.withColumn("target", F.when(F.col("kind") != J.PROPOSE, proposal("about"))).withColumn("replacement", F.when(F.col("kind") == J.SUPERSEDE, proposal("by")))
    return x.select(*[F.col(f.name).cast(f.dataType) for f in J.COMMAND])


@query("journal_decisions")
def journal_decisions(r):
    """Decisions with dual control in one chain a candidate; a keyed state machine, which SQL has not: a test holds it against a loop."""
    return J.decide(journal_commands(r)).select("cand_id", "seq", "kind", "op_key", "outcome", "error", "stream_seq", "previous", "own")


# ---------------------------------------------------------------- source claims
def claim_world(r):
    """(observations, captures, lecturers, authors, decisions): sources that list claims of every type, day by day."""
    caps = r.table("events").selectExpr("event_id AS capture_id", "concat('src', cast(user_id % 3 as string)) AS source_system", "concat('scope', cast(user_id % 4 as string)) AS scope_key", "'v1' AS projection", "date_trunc('day', ts) AS captured_at", "CASE WHEN event_id % 3 <> 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS completeness", "user_id % 12 AS place")
    x = caps.select("capture_id", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("k")).where("(capture_id * 31 + k * 17) % 9 < 4").withColumn("who", F.expr("(place * 40 + k) % 330"))
    x = x.selectExpr(
        "capture_id", "capture_id * 2 AS analysis_id", "k AS claim_id", "who AS record_id",
        "CASE k % 8 WHEN 5 THEN 'ORCID_DECLARED' WHEN 6 THEN 'EMAIL_DECLARED' WHEN 7 THEN CASE WHEN k % 3 = 0 THEN 'SCOPUS_ID_AMBIGUOUS' ELSE 'SCOPUS_ID_UNASSIGNED' END ELSE 'SCOPUS_ID_OWNED' END AS claim_type",
        "concat('raw', cast(k as string)) AS value_raw",
        "CASE WHEN k = 13 OR k = 25 THEN NULL WHEN k % 8 = 5 THEN concat('o', cast(who % 90 as string)) WHEN k % 8 = 6 THEN concat('u', cast(who as string), '@uni.edu.vn') ELSE cast(57000000000 + who % 115 as string) END AS value_normalized",
        "concat('claim|', cast(k as string)) AS claim_key", "k % 4 = 0 AND capture_id % 50 <> 0 AS is_primary", "k % 10 <> 9 AS listed", "concat('rec', cast(who as string)) AS record_key", "CASE WHEN k % 2 = 0 THEN 'URL' ELSE 'EMAIL' END AS key_method",
        "CASE WHEN k % 7 = 0 THEN 'WEAK' ELSE 'STRONG' END AS key_strength", "CASE WHEN k % 9 = 1 THEN NULL ELSE concat('url', cast(who as string)) END AS record_source_id", "CASE WHEN k % 5 = 0 THEN NULL ELSE concat('u', cast(who as string), '@uni.edu.vn') END AS record_email", "'r1' AS rules",
    )
    lec = r.lec.selectExpr("lec_id", "CASE WHEN lec_id % 3 = 0 THEN NULL WHEN lec_id % 40 = 1 THEN concat('url', cast(lec_id % 330 as string)) ELSE concat('url', cast(lec_id as string)) END AS url", "CASE WHEN lec_id % 8 = 0 THEN NULL WHEN lec_id % 50 = 3 THEN concat('u', cast(lec_id % 330 as string), '@uni.edu.vn') ELSE concat('u', cast(lec_id as string), '@uni.edu.vn') END AS email", "CASE WHEN lec_id % 4 = 0 THEN NULL ELSE concat('o', cast(lec_id % 90 as string)) END AS orcid")
    authors = r.author.select("author_id", "scopus_id")
    pairs = r.ident.groupBy("lec_id", "author_id").agg(F.min("status").alias("identity_status")).withColumn("candidate_status", F.when(F.col("identity_status") == "PENDING", F.when(F.col("lec_id") % 2 == 0, "REJECTED").otherwise("PENDING")).otherwise("ACCEPTED"))
    return x, caps.drop("place"), lec, authors, pairs.select("lec_id", "author_id", "candidate_status", "identity_status")


def bridged(r):
    observations, caps, lec, authors, decisions = claim_world(r)
    return cut(CL.bridge(observations, caps, lec, authors, refs=False)), decisions  # one row a claim, read several times


@query("bridge_evidence")
def bridge_evidence(r):
    b, _ = bridged(r)
    return CL.evidence(b).select("lec_id", "author_id", "scopus_id", *CL.CLAIM, "fingerprint", "resolution", "is_primary", "listed", "presence", "n_observed")


@query("bridge_pairs")
def bridge_pairs(r):
    b, decisions = bridged(r)
    return CL.assess(CL.evidence(b), decisions, b).select("lec_id", "author_id", "scopus_id", "class", F.array_join("reasons", ",").alias("reasons"), F.array_join("fingerprints", ",").alias("fingerprints"))


@query("bridge_findings")
def bridge_findings(r):
    b, decisions = bridged(r)
    return CL.findings(b, CL.assess(CL.evidence(b), decisions, b))
