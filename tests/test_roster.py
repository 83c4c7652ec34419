"""Roster plans and rollbacks against plain loops."""

import random

import pytest

from ledgerloom.plans import roster as R

TEXT = ", ".join(f"{f} string" for f in R.FIELDS)


def plain(records, lecturers, bindings):
    rows = {x["lec_id"]: x for x in lecturers}
    by = {k: {} for k in ("staff_code", "email", "orcid", "url", "source_id")}
    for x in lecturers:
        for k in ("staff_code", "email", "orcid", "url"):
            if x[k] is not None:
                by[k].setdefault(x[k], []).append(x["lec_id"])
    bound = {}
    for lec, sid in bindings:
        if lec not in by["source_id"].setdefault(sid, []):
            by["source_id"][sid].append(lec)
        bound.setdefault(lec, set()).add(sid)
    people = [(x["full_name"].strip().lower(), (x["department"] or "").strip().lower(), x["email"], x["lec_id"]) for x in lecturers]
    out = {}
    for r in sorted(records, key=lambda r: r["line"]):
        hits = {k: by[k].get(r[k], []) if r[k] is not None else [] for k in by}
        made = lambda ids: any(isinstance(i, str) for i in ids)
        codes, target = [], None
        if made(hits["staff_code"]) or made(hits["email"]) or made(hits["source_id"]):
            codes = ["duplicate_in_file"]
        elif len(hits["source_id"]) > 1:
            codes = ["ambiguous_source_id"]
        else:
            sc = min(hits["staff_code"], default=None)
            mails = hits["email"]
            if hits["source_id"]:
                target = hits["source_id"][0]
                codes += ["source_id_staff_code_conflict"] * (sc is not None and sc != target) + ["source_id_email_conflict"] * (bool(mails) and target not in mails)
            else:
                codes += ["staff_code_email_conflict"] * (sc is not None and bool(mails) and sc not in mails)
                target = sc if sc is not None else min(mails, default=None)
                codes += ["source_id_bound_elsewhere"] * (target is not None and r["source_id"] is not None and bool(bound.get(target)))
            first = lambda ids: min((i for i in ids if not isinstance(i, str)), default=None)
            holder = first(hits["orcid"])
            codes += ["orcid_conflict"] * ((holder is not None and holder != target) or made(hits["orcid"]))
            codes += ["profile_url_conflict"] * bool(set(hits["url"]) - {target})
        name = (r["full_name"].strip().lower(), (r["department"] or "").strip().lower())
        warned = name[0] != "" and any((a, b) == name and who != target and not (r["email"] and mail and mail != r["email"]) for a, b, mail, who in people)
        if codes:
            action, target = "conflict", None
        elif target is None:
            action = "create"
            new = f"new{r['line']}"
            for k in by:
                if r[k] is not None:
                    by[k].setdefault(r[k], []).append(new)
            people.append((*name, r["email"], new))
        else:
            action = "unchanged" if all(r[f] == rows[target][f] for f in R.FIELDS) else "update"
        changed = {f: (rows[target][f], r[f]) for f in R.FIELDS if r[f] != rows[target][f]} if action == "update" else None
        out[r["line"]] = (action, target, sorted(set(codes)), changed, warned)
    return out


def world(seed):
    rng = random.Random(seed)
    pick = lambda kind, n, none=0.2: None if rng.random() < none else f"{kind}{rng.randrange(n)}"
    person = lambda: dict(full_name=rng.choice(["An", " an", "Bo", "Cy", ""]), staff_code=pick("s", 40), email=pick("m", 40), degree=pick("d", 2), acad_rank=None, job=None, faculty=None, department=pick("k", 3), orcid=pick("o", 60, 0.6), specialization=None, gender=None, birth=None, phone=None, url=pick("u", 60, 0.6), active="true")
    lecturers, codes = [], set()
    for i in range(25):
        p = person()
        if p["staff_code"] in codes:
            p["staff_code"] = None
        codes.add(p["staff_code"])
        lecturers.append(p | {"lec_id": i})
    bindings = [(i, f"q{rng.randrange(15)}") for i in range(0, 25, 2)]
    records = []
    for line in range(60):
        base = dict(rng.choice(lecturers)) if rng.random() < 0.5 else person()
        base.pop("lec_id", None)
        if rng.random() < 0.4:
            base[rng.choice(["degree", "phone", "orcid", "url", "email"])] = pick("x", 4)
        records.append(base | {"line": line, "source_id": pick("q", 25, 0.5)})
    return records, lecturers, bindings


@pytest.mark.parametrize("seed", range(2))
def test_plan_against_a_loop(spark, seed):
    records, lecturers, bindings = world(seed)
    f = lambda rows, head: spark.createDataFrame([tuple(r[c.split()[0]] for c in f"{head}, {TEXT}".split(", ")) for r in rows], f"{head}, {TEXT}")
    planned = R.plan(f(records, "line long, source_id string"), f(lecturers, "lec_id long"), spark.createDataFrame(bindings, "lec_id long, source_id string"))
    got = {r.line: (r.action, r.lec_id, list(r.blocking), None if r.changed is None else {k: (v.old, v.new) for k, v in r.changed.items()}, r.warned) for r in planned.collect()}
    want = plain(records, lecturers, bindings)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert {v[0] for v in want.values()} >= {"conflict", "create", "update"}


def test_rollback(spark):
    f = spark.createDataFrame
    snaps = [(1, 1, 7, "A", 10, None), (2, 1, 3, "A", 5, ("old", "o@x")), (3, 1, 8, "B", 6, ("later", "l@x")), (4, 2, 7, "A", 10, None), (5, 2, 9, "CRAW", 99, ("c", "c")), (6, 3, 7, "A", 10, None), (7, 4, 7, "A", 1, None), (8, 5, 7, "A", 1, None), (9, 6, 7, "A", 1, None), (10, 6, 2, "C", 1, None), (11, 77, 7, "A", 1, None), (12, 8, 3, "A", 1, ("x", "y"))]
    snapshots = f(snaps, "snap_id long, lec_id long, import_id long, source_system string, created_at long, canonical struct<full_name string, email string>")
    created = f([(2, 7), (4, 7), (5, 3), (9, 7)], "lec_id long, import_id long")
    lecturers = f([(i,) for i in (1, 2, 3, 4, 5, 6, 8, 9)], "lec_id long")
    users, identities = f([(4, "ADMIN"), (2, "LECTURER"), (1, "ADMIN")], "lec_id long, role string"), f([(5,), (1,)], "lec_id long")
    got = {r.lec_id: (r.action, r.blocker, r.restored and tuple(r.restored)) for r in R.rollback(7, snapshots, created, lecturers, users, identities).collect()}
    assert got == {1: ("RESTORE", None, ("later", "l@x")), 2: ("DELETE", None, None), 3: ("KEEP_MANUAL", None, None), 4: ("DELETE", "LINKED_ACCOUNT", None), 5: ("DELETE", "SCOPUS_IDENTITY", None), 6: ("KEEP_OTHER_SOURCE", None, None), 9: ("DELETE", None, None)}
    audit = f([(7, "IMPORTED"), (8, "IMPORTED"), (8, "ROLLED_BACK")], "entity_id long, action string")
    assert [R.rollback_state(audit, i).first()["error"] for i in (7, 8, 9)] == [None, "LECTURER_IMPORT_ALREADY_ROLLED_BACK", "LECTURER_IMPORT_NOT_FOUND"]


def test_query(spark, sf_dir):
    from ledgerloom.plans.q_exports import roster_world
    from ledgerloom.plans.standins import Relations
    from ledgerloom.registry import QUERIES

    records, lecturers, bindings = ([r.asDict() for r in f.collect()] for f in roster_world(Relations(spark, sf_dir)))
    want = plain(records, lecturers, [(b["lec_id"], b["source_id"]) for b in bindings])
    got = {r.line: (r.action, r.lec_id, r.blocking, r.changed, r.warned) for r in QUERIES["roster_import_plan"](spark, sf_dir).collect()}
    assert got == {k: (a, t, ",".join(codes), ",".join(sorted(c or ())), w) for k, (a, t, codes, c, w) in want.items()}
    assert {v[0] for v in want.values()} == {"conflict", "create", "update", "unchanged"}
