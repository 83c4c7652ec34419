"""Authors, variants and links against a loop over occurrences."""

import random

import pytest

from ledgerloom.plans import authors as A


def plain(occ, provenance, authors, variants, links):
    known, forms, pairs, places = dict(authors), set(variants), {}, {}
    for p, s, o in links:
        pairs[p, s], places[p, o] = o, s
    action, first, out, lost = {}, {}, {}, []
    for seq, raw, sid, display, full, order in sorted(occ):
        pub = provenance.get(raw)
        if pub is None:
            lost.append((seq, raw, sid))
            continue
        name = full or display
        if sid not in known:
            known[sid], action[sid] = name or sid, "CREATED"
        elif known[sid] in (None, "", sid) and name:
            known[sid] = name
            action[sid] = action.get(sid) if action.get(sid) == "CREATED" else "NAMED"
        action.setdefault(sid, "EXISTING")
        for kind, v in ((A.DISPLAY, display), (A.FULL, full)):
            if v and (sid, kind, v) not in forms:
                forms.add((sid, kind, v))
                first[sid, kind, v] = raw
        if (pub, sid) in pairs:
            old = pairs[pub, sid]
            drift = old is not None and order is not None and old != order
            out[seq] = ("AUTHOR_POSITION_DRIFT", str(old)) if drift else ("EXISTING", None)
        elif order is None:
            out[seq] = ("AUTHOR_ORDER_MISSING", None)
        elif (pub, order) in places:
            out[seq] = ("AUTHOR_ORDER_CONFLICT", places[pub, order])
        else:
            pairs[pub, sid], places[pub, order] = order, sid
            out[seq] = ("CREATED", None)
    return {(s, action[s], known[s]) for s in action}, {(*k, v) for k, v in first.items()}, out, lost


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    occ = [(i, rng.randrange(60), f"s{rng.randrange(12)}", rng.choice([None, "", "A", "B"]), rng.choice([None, "", "Aa", "Bb"]), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(400)]
    provenance = {r: rng.randrange(9) for r in range(60) if r % 7}
    authors = [("s1", "Known"), ("s2", "s2"), ("s3", None)]
    variants = [("s1", A.DISPLAY, "A"), ("s4", A.FULL, "Bb")]
    links = [(0, "s1", 1), (0, "s2", 2), (1, "s3", 3), (2, "s0", None)]
    f = spark.createDataFrame
    frame = A.attributed(f(occ, "seq long, raw_id long, scopus_id string, display string, full_name string, author_order int"), f(list(provenance.items()), "raw_id long, pub_id long"))
    good = frame.where("pub_id is not null")
    want = plain(occ, provenance, authors, variants, links)
    assert {tuple(r) for r in A.authors(good, f(authors, "scopus_id string, preferred string")).collect()} == want[0]
    assert {tuple(r) for r in A.variants(good, f(variants, "scopus_id string, kind string, name string")).collect()} == want[1]
    assert {r.seq: (r.outcome, r.other) for r in A.links(good, f(links, "pub_id long, scopus_id string, author_order int")).collect()} == want[2]
    assert sorted((r.seq, r.raw_id, r.scopus_id) for r in A.orphans(frame).collect()) == want[3]
    assert len({x for x, _ in want[2].values()}) == 5
