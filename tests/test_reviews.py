"""Batches of review commands against a plain loop over one state."""

import random

import pytest

from ledgerloom.plans import reviews as R

COMMANDS = "seq long, item long, grp long, action string, cand_id long, obs_id long, version long, user_id long, reason string, lecturer long, is_main boolean"
ACTIVE = ("PENDING", "ACCEPTED")


class Plain:
    """All commands one by one over dictionaries, with a copy of the state for each group."""

    def __init__(self, candidates, observations, users, identities, history):
        self.cand = {c[0]: dict(lec=c[1], author=c[2], status=c[3], version=c[4]) for c in candidates}
        self.obs = {o[0]: o[1:] for o in observations}
        self.users = {u[0]: u[1:] for u in users}
        self.ident = {(i[0], i[1]): i[2] for i in identities}
        self.reviews = [tuple(h) for h in history]

    def fail(self, action, c, obs, version, user, reason, grp=False):
        if user not in self.users:
            return "REVIEWER_NOT_FOUND"
        role, active = self.users[user]
        if not active or role not in (("ADMIN",) if action == "REVOKE" else ("ADMIN", "REVIEWER")):
            return "REVIEWER_NOT_AUTHORIZED"
        said = bool((reason or "").strip())
        if action != "ACCEPT" and not said:
            return "REVOCATION_REASON_REQUIRED" if action == "REVOKE" else "INVALID_REVIEW_REASON"
        if c not in self.cand:
            return "CANDIDATE_NOT_FOUND"
        x = self.cand[c]
        pair = (x["lec"], x["author"])
        mine = any(h[0] == c and h[2] == "ACCEPT" for h in self.reviews)
        if grp and any(y["author"] == x["author"] and y["status"] in ACTIVE and k != c for k, y in self.cand.items()):
            return "GROUP_SHARED_SCOPUS_AUTHOR"
        if action in ("ACCEPT", "REJECT") and (c, obs, action) in self.reviews:
            if action == "REJECT":
                return "IDEMPOTENT"
            return "IDEMPOTENT" if self.ident.get(pair) == "APPROVED" and mine else "CANDIDATE_ALREADY_DECIDED_CONFLICT"
        need, code = {"REVOKE": ("ACCEPTED", "CANDIDATE_NOT_ACCEPTED"), "REOPEN": ("REJECTED", "CANDIDATE_NOT_REJECTED")}.get(action, ("PENDING", "CANDIDATE_ALREADY_DECIDED_CONFLICT"))
        if x["status"] != need:
            return code
        if x["version"] != version:
            return "STALE_CANDIDATE_VERSION"
        if action == "REVOKE":
            return None if self.ident.get(pair) == "APPROVED" and mine else code
        if action == "REOPEN":
            return None if any(h[0] == c and h[2] == "REJECT" for h in self.reviews) else code
        if obs not in self.obs:
            return "OBSERVATION_NOT_FOUND"
        of, current, has_pub = self.obs[obs]
        if of != c:
            return "OBSERVATION_CANDIDATE_MISMATCH"
        if not current:
            return "STALE_CANDIDATE_OBSERVATION"
        if action == "REJECT":
            return None
        if any(k[1] == x["author"] and s == "APPROVED" and k[0] != x["lec"] for k, s in self.ident.items()):
            return "SCOPUS_AUTHOR_ALREADY_APPROVED_FOR_OTHER_LECTURER"
        if self.ident.get(pair) == "REVOKED":
            return "IDENTITY_REVOKED_REACCEPT_UNSUPPORTED"
        if pair in self.ident and not mine:
            return "PREEXISTING_IDENTITY_PROVENANCE_CONFLICT"
        rivals = lambda key: sum(y[key] == x[key] and y["status"] in ACTIVE for y in self.cand.values())
        if not said and (not has_pub or rivals("author") > 1 or rivals("lec") > 1):
            return "REVIEW_REASON_REQUIRED_FOR_WEAK_EVIDENCE"
        return None

    def do(self, action, c, obs):
        x = self.cand[c]
        before, x["version"] = x["status"], x["version"] + 1
        x["status"] = {"ACCEPT": "ACCEPTED", "REJECT": "REJECTED"}.get(action, "PENDING")
        if action in ("ACCEPT", "REJECT"):
            self.reviews.append((c, obs, action))
        if action in ("ACCEPT", "REVOKE"):
            self.ident[x["lec"], x["author"]] = "APPROVED" if action == "ACCEPT" else "REVOKED"
        return before, x["status"], x["version"]

    def run(self, commands):
        out, groups = {}, {}
        for row in commands:
            groups.setdefault(row[0], []).append(row)
        for seq in sorted(groups):
            rows = sorted(groups[seq], key=lambda r: r[1])
            if rows[0][2] is None:
                seq, item, _, action, c, obs, version, user, reason, _, _ = rows[0]
                error = self.fail(action, c, obs, version, user, reason)
                if error is None:
                    out[seq, item] = (None, "APPLIED", *self.do(action, c, obs))
                else:
                    now = self.cand[c]["version"] if c in self.cand else None
                    out[seq, item] = (None, error, None, None, now) if error == "IDEMPOTENT" else (error, None, None, None, now)
                continue
            members = [r for r in rows if r[4] is not None]
            ids = [r[4] for r in members]
            fault = None
            if not 2 <= len(ids) <= 10:
                fault = "GROUP_NEEDS_TWO_TO_TEN_CANDIDATES"
            elif len(set(ids)) < len(ids):
                fault = "GROUP_DUPLICATE_CANDIDATE"
            elif not all((r[8] or "").strip() for r in members):
                fault = "GROUP_REASON_REQUIRED"
            elif len(members) < len(rows):
                fault = "GROUP_PRIMARY_NOT_IN_GROUP"
            errors = {}
            for r in members:
                own = fault or ("CANDIDATE_NOT_FOUND" if r[4] not in self.cand else "GROUP_CANDIDATE_LECTURER_MISMATCH" if self.cand[r[4]]["lec"] != r[9] else None)
                errors[r[1]] = own or self.fail("ACCEPT", r[4], r[5], r[6], r[7], r[8], grp=True)
            ok = all(e in (None, "IDEMPOTENT") for e in errors.values())
            for r in members:
                e, now = errors[r[1]], self.cand[r[4]]["version"] if r[4] in self.cand else None
                if e is None and ok:
                    out[seq, r[1]] = (None, "APPLIED", *self.do("ACCEPT", r[4], r[5]))
                elif e in (None, "IDEMPOTENT"):
                    out[seq, r[1]] = (None, e or "GROUP_FAILED", None, None, now)
                else:
                    out[seq, r[1]] = (e, None, None, None, now)
        return out


def world(seed):
    rng = random.Random(seed)
    pairs = rng.sample([(lec, a) for lec in range(12) for a in range(14)], 50)
    candidates = [(i, lec, a, rng.choice(["PENDING"] * 6 + ["REJECTED", "ACCEPTED"]), rng.randint(0, 2)) for i, (lec, a) in enumerate(pairs)]
    observations, history, identities, owned = [], [], [], set()
    for i, lec, a, status, _ in candidates:
        observations += [(2 * i, i, False, rng.random() < 0.7), (2 * i + 1, i, True, rng.random() < 0.7)]
        if status == "REJECTED":
            history.append((i, 2 * i, "REJECT"))
        if status == "ACCEPTED":
            if a in owned:
                continue
            owned.add(a)
            history.append((i, 2 * i, "ACCEPT"))
            identities.append((lec, a, "APPROVED"))
    for lec, a in rng.sample([(lec, a) for _, lec, a, s, _ in candidates if s == "PENDING" and a not in owned], 3):
        identities.append((lec, a, "REVOKED"))
    users = [(0, "ADMIN", True), (1, "REVIEWER", True), (2, "VIEWER", True), (3, "ADMIN", False)]
    versions = {c[0]: c[4] for c in candidates}
    by_lec = {}
    for c in candidates:
        by_lec.setdefault(c[1], []).append(c[0])
    commands = []
    for seq in range(160):
        user, reason = rng.choice([0] * 6 + [1] * 3 + [2, 3, 9]), rng.choice([None, " ", "why"] + ["because"] * 5)
        version = lambda c: versions.get(c, 0) + rng.choice([0, 0, 0, 0, 1, 2, 3])
        if rng.random() < 0.15:
            lec = rng.choice(list(by_lec))
            members = rng.sample(by_lec[lec], min(len(by_lec[lec]), rng.randint(1, 4)))
            members += rng.choice([[]] * 6 + [[members[0]], [999], [rng.randrange(50)]])
            commands += [(seq, k, seq, "ACCEPT", c, 2 * c + 1, versions.get(c, 0), 0, "all", lec, k == 0) for k, c in enumerate(members)]
            commands += [(seq, 99, seq, "ACCEPT", None, None, None, 0, "all", lec, True)] * (rng.random() < 0.1)
        else:
            c = rng.choice([*range(50), 999])
            commands.append((seq, 0, None, rng.choice(["ACCEPT", "ACCEPT", "REJECT", "REVOKE", "REOPEN"]), c, rng.choice([2 * c + 1] * 5 + [2 * c, 1, 5000]), version(c), user, reason, None, None))
    return commands, candidates, observations, users, identities, history


def frames(spark, w):
    names = [COMMANDS, "cand_id long, lec_id long, author_id long, status string, version long", "obs_id long, cand_id long, is_current boolean, has_pub boolean", "user_id long, role string, active boolean", "lec_id long, author_id long, status string", "cand_id long, obs_id long, action string"]
    return [spark.createDataFrame(rows, s) for rows, s in zip(w, names)]


@pytest.mark.parametrize("seed", range(2))
def test_batches_against_a_loop(spark, seed):
    w = world(seed)
    got = {(r.seq, r.item): (r.error, r.outcome, r.from_status, r.to_status, r.version) for r in R.review_batch(*frames(spark, w)).collect()}
    assert got == Plain(*w[1:]).run(w[0])


def test_group_with_a_stale_member_writes_nothing(spark):
    candidates = [(1, 7, 1, "PENDING", 0), (2, 7, 2, "PENDING", 0), (3, 7, 3, "PENDING", 0), (4, 8, 1, "PENDING", 0)]
    observations = [(i, i, True, True) for i in range(1, 5)]
    group = lambda seq, versions: [(seq, k, seq, "ACCEPT", c, c, v, 0, "same person", 7, k == 0) for k, (c, v) in enumerate(versions)]
    one = lambda seq, action, c, v: (seq, 0, None, action, c, c, v, 0, "r", None, None)
    commands = [*group(1, [(2, 0), (3, 5)]), *group(2, [(1, 0), (2, 0)]), one(3, "REJECT", 4, 0), *group(4, [(1, 0), (2, 0)]), one(5, "REVOKE", 1, 1), one(6, "ACCEPT", 1, 2), one(7, "REOPEN", 4, 1), one(8, "ACCEPT", 4, 2)]
    f = frames(spark, (commands, candidates, observations, [(0, "ADMIN", True)], [], []))
    decided = R.review_batch(*f)
    got = {(r.seq, r.item): r.error or r.outcome for r in decided.collect()}
    assert got == {
        (1, 0): "GROUP_FAILED", (1, 1): "STALE_CANDIDATE_VERSION", (2, 0): "GROUP_SHARED_SCOPUS_AUTHOR", (2, 1): "GROUP_FAILED", (3, 0): "APPLIED",
        (4, 0): "APPLIED", (4, 1): "APPLIED", (5, 0): "APPLIED", (6, 0): "CANDIDATE_ALREADY_DECIDED_CONFLICT", (7, 0): "APPLIED", (8, 0): "APPLIED",
    }
    assert {r.grp: r.error for r in R.group_errors(decided, f[0]).collect()} == {1: "STALE_CANDIDATE_VERSION", 2: "GROUP_SHARED_SCOPUS_AUTHOR", 4: None}
    assert sorted(map(tuple, R.identity_rows(decided, f[1]).collect())) == [(7, 1, "REVOKED"), (7, 2, "APPROVED"), (8, 1, "APPROVED")]
    assert [tuple(r) for r in R.main_ids(decided, f[0], f[1]).collect()] == [(4, 7, 1)]
    rows = sorted((r.seq, r.item, r.action, r.from_status, r.to_status, r.compensation) for r in R.review_rows(decided, f[0]).collect())
    assert rows[-3:-1] == [(5, 0, "REOPEN", "ACCEPTED", "PENDING", "REVOKE"), (7, 0, "REOPEN", "REJECTED", "PENDING", "REOPEN_REJECTED")]
    assert sorted((r.seq, r.item, r.action) for r in R.audit_rows(decided).collect() if 4 < r.seq < 8) == [(5, 0, "CANDIDATE_REOPENED"), (5, 0, "IDENTITY_REVOKED"), (7, 0, "CANDIDATE_REOPENED_FROM_REJECT")]


def test_empty_batch(spark):
    w = world(0)
    assert R.review_batch(*frames(spark, ([], *w[1:]))).count() == 0


def test_query(spark, sf_dir):
    """The registered query over its whole tables against the loop."""
    from ledgerloom.plans.q_reviews import review_world
    from ledgerloom.plans.standins import Relations
    from ledgerloom.registry import QUERIES

    w = [[tuple(r) for r in f.collect()] for f in review_world(Relations(spark, sf_dir))]
    want = Plain(*w[1:]).run(w[0])
    got = {(r.seq, r.item): (r.error, r.outcome, r.from_status, r.to_status, r.version) for r in QUERIES["review_batch"](spark, sf_dir).collect()}
    assert got == want
    assert {a for (_, a, *_) in got.values()} >= {"APPLIED", "IDEMPOTENT"} and len({e for (e, *_) in got.values()}) > 6


def test_unknown_candidates_are_decided_once(spark, monkeypatch):
    """Commands on unknown candidates have no lecturer: in the rounds they would all be one window's rows."""
    unknown = []
    monkeypatch.setattr(R, "fold", lambda commands, fold=R.fold: (unknown.append(commands.where("not found").count()), fold(commands))[1])
    commands, *rest = world(0)
    more = [(10_000 + k, 0, None, "ACCEPT", 90_000 + k, 1, 0, 1, "seen", None, None) for k in range(50)]
    got = R.review_batch(*frames(spark, ([*commands, *more], *rest)))
    assert sum(n > 0 for n in unknown) == 1 and max(unknown) >= 50
    assert got.where("cand_id >= 90000 and error is not null and outcome is null").count() == 50
