"""Roster files: what an import does with each record, and what its rollback does with each person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.diff import changed_fields
from ..session import cut

#: What is compared, as the import keeps it.
FIELDS = "full_name staff_code email degree acad_rank job faculty department orcid specialization gender birth phone url active".split()
#: A source whose captures don't own a person.
CRAWLED = "CRAW"


def _holders(lecturers: DataFrame, key: str) -> DataFrame:
    """(key, <key>_lec, <key>_n): the least of a key's holders, and how many there are."""
    return lecturers.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min("lec_id").alias(f"{key}_lec"), F.countDistinct("lec_id").alias(f"{key}_n"))


def matched(records: DataFrame, lecturers: DataFrame, bindings: DataFrame) -> DataFrame:
    """records with the person that each means (target) and the codes that stand against it, by what was there before the file."""
    x = records
    for key in ("staff_code", "email", "orcid", "url"):
        x = x.join(_holders(lecturers, key).withColumnRenamed("k", key), key, "left")
    x = x.join(_holders(bindings.select("lec_id", "source_id"), "source_id").withColumnRenamed("k", "source_id"), "source_id", "left")
    by_source = F.col("source_id_lec").isNotNull()
    x = x.withColumn("target", F.when(F.col("source_id_n") > 1, None).when(by_source, F.col("source_id_lec")).otherwise(F.coalesce("staff_code_lec", "email_lec")))
    own = lecturers.select(F.col("lec_id").alias("target"), F.struct(*FIELDS).alias("now"))
    bound = bindings.select(F.col("lec_id").alias("target")).distinct().withColumn("bound", F.lit(True))
    x = x.join(own, "target", "left").join(bound, "target", "left")
    target, mail_elsewhere = F.col("target"), F.col("email_n").isNotNull() & ~F.col("now.email").eqNullSafe(F.col("email"))
    codes = [
        F.when(by_source & F.col("staff_code_lec").isNotNull() & (F.col("staff_code_lec") != target), "source_id_staff_code_conflict"),
        F.when(by_source & mail_elsewhere, "source_id_email_conflict"),
        F.when(~by_source & F.col("staff_code_lec").isNotNull() & mail_elsewhere, "staff_code_email_conflict"),
        F.when(~by_source & target.isNotNull() & F.col("source_id").isNotNull() & F.col("bound"), "source_id_bound_elsewhere"),
        F.when(F.col("orcid_lec").isNotNull() & ~F.col("orcid_lec").eqNullSafe(target), "orcid_conflict"),
        F.when(F.col("url_n") - F.coalesce((F.col("now.url") == F.col("url")).cast("int"), F.lit(0)) > 0, "profile_url_conflict"),
    ]
    against = F.when(F.col("source_id_n") > 1, F.array(F.lit("ambiguous_source_id"))).otherwise(F.array_compact(F.array(*codes)))
    return x.select(*records.columns, "target", "now", against.alias("against"))


def _claims(x: DataFrame, *keys: str) -> DataFrame:
    """(line, kind, key, creates) of records' keys that later records of the file may repeat."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"))) for k in keys])))
    return x.select("line", "creates", each.alias("c")).select("line", "creates", "c.kind", "c.key")


def claimed_before(x: DataFrame) -> DataFrame:
    """(line, repeated, taken): whether an earlier record of the file that makes a person has the record's source id, code or e-mail,
    and the other keys that one has."""
    claims = _claims(x, "source_id", "staff_code", "email", "orcid", "url")
    first = claims.where("creates").groupBy("kind", "key").agg(F.min("line").alias("first"))
    met = claims.join(first, ["kind", "key"]).where("first < line")
    return met.groupBy("line").agg(F.bool_or(F.col("kind").isin("source_id", "staff_code", "email")).alias("repeated"), F.collect_set(F.when(F.col("kind").isin("orcid", "url"), F.col("kind"))).alias("taken"))


def same_name_warnings(x: DataFrame, lecturers: DataFrame) -> DataFrame:
    """(line, warned): people with the record's name and department whom e-mail can't tell from it, stored ones or made by earlier
    records. Counts by name and by name and e-mail decide, so a common name costs no pairs."""
    key = lambda df: df.withColumn("nd", F.concat_ws("\0", F.lower(F.trim("full_name")), F.lower(F.trim(F.coalesce("department", F.lit(""))))))
    rows = key(x).where(F.trim("full_name") != "")
    stored = key(lecturers.select("lec_id", "full_name", "department", "email"))
    by_name = stored.groupBy("nd").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("email").isNull()).alias("n_blank"))
    by_mail = stored.where("email is not null").groupBy("nd", "email").agg(F.count(F.lit(1)).alias("n_mail"))
    made = F.col("creates").cast("int")
    w = lambda *k: Window.partitionBy(*k).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    y = rows.withColumn("f", F.coalesce(F.sum(made).over(w("nd")), F.lit(0))).withColumn("f_blank", F.coalesce(F.sum(made * F.col("email").isNull().cast("int")).over(w("nd")), F.lit(0)))
    y = y.withColumn("f_mail", F.when(F.col("email").isNotNull(), F.coalesce(F.sum(made).over(w("nd", "email")), F.lit(0))).otherwise(0))
    y = y.join(by_name, "nd", "left").join(by_mail, ["nd", "email"], "left").join(stored.select(F.col("lec_id").alias("target"), F.col("nd").alias("t_nd"), F.col("email").alias("t_mail"), F.lit(1).alias("t")), "target", "left")
    got = lambda c: F.coalesce(c, F.lit(0))
    self_, self_blank = got(F.when(F.col("t_nd") == F.col("nd"), F.col("t"))), F.col("t_mail").isNull()
    self_mail = F.coalesce(F.col("t_mail") == F.col("email"), F.lit(False))
    any_ = got(F.col("n")) - self_ + F.col("f")
    untold = got(F.col("n_blank")) - self_ * self_blank.cast("int") + got(F.col("n_mail")) - self_ * self_mail.cast("int") + F.col("f_blank") + F.col("f_mail")
    return y.select("line", F.when(F.col("email").isNull(), any_ > 0).otherwise(untold > 0).alias("warned"))


def plan(records: DataFrame, lecturers: DataFrame, bindings: DataFrame) -> DataFrame:
    """(line, action, lec_id, blocking, changed, warned): conflict, create, update or unchanged for each record of a file, by line.

    records: line (distinct), source_id and FIELDS, codes and e-mails normalised; lecturers: lec_id and FIELDS; bindings: lec_id,
    source_id of snapshots. A record that makes a person claims its keys, so a later one with them is a conflict; one that is a
    conflict claims nothing. So whether a record makes a person hangs on earlier ones, and is settled in rounds, each of which
    joins keys: as many as the longest chain of records that hang on each other. changed: each changed field's old and new value.
    """
    x = cut(matched(records, lecturers, bindings))
    open_ = F.col("target").isNull() & (F.size("against") == 0)
    state = x.withColumn("creates", open_).withColumn("repeated", F.lit(False)).withColumn("taken", F.array().cast("array<string>"))
    while True:
        told = claimed_before(state)
        new = x.join(told, "line", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))).withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
        new = cut(new.withColumn("creates", open_ & ~F.col("repeated") & (F.size("taken") == 0)))
        moved = new.select("line", "creates").join(state.select("line", F.col("creates").alias("was")), "line").where("creates <> was").limit(1).count()
        state = new
        if not moved:
            break
    late = F.transform("taken", lambda k: F.when(k == "orcid", "orcid_conflict").otherwise("profile_url_conflict"))
    blocking = F.when(F.col("repeated"), F.array(F.lit("duplicate_in_file"))).otherwise(F.array_sort(F.array_union("against", late)))
    changed = changed_fields({f: (F.col(f"now.{f}"), F.col(f)) for f in FIELDS})
    action = F.when(F.size(blocking) > 0, "conflict").when(F.col("target").isNull(), "create").when(F.size(changed) == 0, "unchanged").otherwise("update")
    unmet = state.withColumn("target", F.when(~F.col("repeated"), F.col("target")))  # a repeated record is compared with everyone
    y = state.join(same_name_warnings(unmet, lecturers), "line", "left")
    return y.select("line", action.alias("action"), F.when(action.isin("update", "unchanged"), F.col("target")).alias("lec_id"), blocking.alias("blocking"), F.when(action == "update", changed).alias("changed"), F.coalesce("warned", F.lit(False)).alias("warned"))


def absent(planned: DataFrame, bindings: DataFrame) -> DataFrame:
    """People whom the source named before and this file doesn't."""
    return bindings.select("lec_id").distinct().join(planned.where("lec_id is not null").select("lec_id"), "lec_id", "left_anti")


def rollback_state(audit: DataFrame, import_id) -> DataFrame:
    """Why an import can't be rolled back, or null: one row (error). audit: entity_id, action."""
    of = audit.where(F.col("entity_id") == import_id)
    return of.agg(F.when(F.count_if(F.col("action") == "IMPORTED") == 0, "LECTURER_IMPORT_NOT_FOUND").when(F.count_if(F.col("action") == "ROLLED_BACK") > 0, "LECTURER_IMPORT_ALREADY_ROLLED_BACK").alias("error"))


def rollback(import_id, snapshots: DataFrame, created: DataFrame, lecturers: DataFrame, users: DataFrame, identities: DataFrame) -> DataFrame:
    """(lec_id, action, blocker, restored): what undoing an import does with each person whom it touched.

    RESTORE to what the last snapshot of another import says, as later ones are still true; KEEP_OTHER_SOURCE where that has no fields;
    DELETE whom an import made and no other names; KEEP_MANUAL whom none made. Accounts of other roles than LECTURER, and identities,
    block a deletion (blocker), and one blocked person blocks the whole rollback. snapshots: snap_id, lec_id, import_id,
    source_system, created_at, canonical (a struct, or null); created: lec_id, import_id; users: lec_id, role; identities: lec_id.
    """
    mine = snapshots.where(F.col("import_id") == import_id).select("lec_id").union(created.where(F.col("import_id") == import_id).select("lec_id"))
    touched = mine.where("lec_id is not null").distinct().join(lecturers.select("lec_id"), "lec_id", "left_semi")
    others = snapshots.where(~F.col("import_id").eqNullSafe(import_id) & (F.col("source_system") != CRAWLED))
    last = others.join(touched, "lec_id", "left_semi").groupBy("lec_id").agg(F.max_by(F.struct("canonical"), F.struct("created_at", "snap_id")).alias("last"))
    ever = created.select("lec_id").distinct().withColumn("made", F.lit(True))
    held = users.where("lec_id is not null and role <> 'LECTURER'").select("lec_id").distinct().withColumn("account", F.lit(True))
    linked = identities.select("lec_id").distinct().withColumn("identity", F.lit(True))
    x = touched.join(last, "lec_id", "left").join(ever, "lec_id", "left").join(held, "lec_id", "left").join(linked, "lec_id", "left")
    action = F.when(F.col("last").isNotNull(), F.when(F.col("last.canonical").isNotNull(), "RESTORE").otherwise("KEEP_OTHER_SOURCE")).when(F.col("made"), "DELETE").otherwise("KEEP_MANUAL")
    blocker = F.when(action == "DELETE", F.when(F.col("account"), "LINKED_ACCOUNT").when(F.col("identity"), "SCOPUS_IDENTITY"))
    return x.select("lec_id", action.alias("action"), blocker.alias("blocker"), F.when(action == "RESTORE", F.col("last.canonical")).alias("restored"))
