from collections import defaultdict

from ledgerloom.llm import lines


def brute(rows, spare=None):
    """rows: (id, text), each id once."""
    where, docs, least, of = defaultdict(list), defaultdict(set), {}, defaultdict(lambda: defaultdict(set))
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            for j, t in enumerate(lines.templates(line.encode())):
                where[t].append((i, k))
                docs[t].add(i)
                of[i][k].add(t)
                need = lines.least_of(len(line.split())) if j == 0 else lines.LEAST_DOCS
                least[t] = min(need, least.get(t, need))
    recurring = {t for t in where if len(docs[t]) >= least[t]}
    gone = {x for t in recurring for x in where[t] if x != min(where[t])}
    size = lambda i, k: len(dict(rows)[i].split("\n")[k].encode()) + 1
    for i in {i for i, _ in gone} if spare else ():
        found = [(len(docs[t]), -size(i, k), min(where[t])) for k, ts in of[i].items() for t in ts if t in recurring and (i, k) != min(where[t])]
        other = min(found)[2][0]
        known = set().union(*of[other].values())
        larger = max(len((dict(rows)[x] or "").encode()) + 1 for x in (i, other))
        if other != i and sum(size(i, k) for k, ts in of[i].items() if ts & known) >= spare * larger:
            gone = {x for x in gone if x[0] != i}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_templates():
    assert lines.templates(b"two words") == [b"2 two words"] and lines.templates(b"1 2 3 x") == lines.templates(b" ") == []
    assert lines.templates(b"Page 3  of\t12 here") == [b"5 Page <*> of <*> here"]
    got = lines.templates(b"posted by alice in news today again")
    assert got[0] == b"7 posted by alice in news today again" and b"7 posted by <*> in news today again" in got and len(got) == 6
    assert len(lines.templates(b"a " * 40)) == 39 and [lines.least_of(n) for n in (1, 2, 3, 50, 51)] == [10, 10, 3, 3, 2]


def test_against_brute_force(spark, docs_of, prose):
    notice = "Share this page with all your good friends"
    rows = [(i, "\n".join([prose(90, i), notice, f"Posted by {prose(1, i)} in our news section", f"Page {i} of 90", prose(9, i % 4), "Of.", "", prose(9, 5)])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, f"{notice}\n{notice}"), *((200 + i, f"{prose(70, 77)} {'abcd'[i % 4]} {prose(40, 8)}\nMore\n{prose(60, 9 + i // 2)}") for i in range(12)), (300, f"{prose(5, 1)} 1 {prose(5, 2)}\n{prose(5, 1)} word {prose(5, 2)}"), (301, f"{prose(5, 1)} other {prose(5, 2)}"), (104, f"{prose(800, 1)}\n{notice}"), (105, "\n".join(f"x {prose(6, k)}" for k in range(300)))]
    got = lines.drop_recurring(docs_of(rows), details="found")
    assert got.columns[:-1] == docs_of(rows).columns
    want = brute(rows)
    for r in got.collect():
        assert r.text == want[r.doc_id], r.doc_id
        assert r.found.n_lines == len((dict(rows)[r.doc_id] or "").split("\n"))
    assert sum(notice in (t or "") for t in want.values()) == sum("More" in (t or "") for t in want.values()) == 1
    assert sum(prose(70, 77) in (t or "") for t in want.values()) == 1 and sum(len(t or "") == 0 for t in want.values()) >= 7
    assert sum("Posted by" in (t or "") for t in want.values()) == 1


def test_keys_name_templates():
    line = b"a b 7 c d e f g h i j k l m n o p"
    want = [lines.template_key(t.split()[1:]) for t in lines.templates(line)]
    tokens = lines.parsed(line)[0]
    (a, m), (_, b) = lines.halves(len(tokens))
    assert [lines.template_key(tokens), *lines.opened_keys(tokens, a, m), *lines.opened_keys(tokens, m, b)] == want
    long = b" ".join(b"w%s" % bytes([97 + i % 26, 97 + i // 26 % 26]) for i in range(60_000))
    assert len(set(lines.opened_keys(long.split(), 2, 60_000))) == 59_998


def test_copies_can_be_spared(docs_of, prose):
    notice = "Share this page with all your good friends"
    long = [prose(12, k) for k in range(20)]
    copies = [(i, "\n".join([*long[:i], prose(12, 50 + i), *long[i + 1 :], notice])) for i in range(6)]
    rows = [*copies, (6, copies[0][1]), (7, copies[0][1]), (8, f"{prose(9, 99)}\n{notice}"), (9, f"{long[0]}\n{notice}"), (None, notice), (10, None)]
    # the notice's first line is that of the row without id, so the first copy and row 8 lose theirs
    want = dict(rows) | {0: copies[0][1].removesuffix("\n" + notice), 8: prose(9, 99), 9: ""}
    assert {r.doc_id: r.text for r in lines.drop_recurring(docs_of(rows), spare=0.8).collect()} == want
    assert all(not r.text for r in lines.drop_recurring(docs_of(rows)).collect() if r.doc_id in (6, 7))


def test_repeated_rows(docs_of):
    line = "the same long line stands here"
    rows = [(1, line)] * 2 + [(None, line), (2, line), (2, "other text that is alone, and long enough\n" + line)]
    got = sorted((str(r.doc_id), r.text) for r in lines.drop_recurring(docs_of(rows)).collect())
    assert got == sorted([("1", "")] * 2 + [("None", line), ("2", ""), ("2", "other text that is alone, and long enough")])
    assert lines.drop_recurring(docs_of([])).count() == 0
