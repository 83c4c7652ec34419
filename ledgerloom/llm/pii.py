"""Personal data: fixed patterns, and spans found by weak supervision. Labelers vote, expectation-maximisation weighs them, and a
classifier trained on its posteriors decides. Only DataFrame functions touch texts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# The base patterns. Possessive forms, and starts only where a run of the first characters starts or the last match
# ended, match the same spans as the plain forms and take time in proportion to the text, whatever it holds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Forms that the base patterns don't cover: written-out addresses, account and social security numbers, other numbers, names.
HANDLE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NUMBER = r"\(?(?<![A-Za-z0-9])[0-9](?:[\x20().-]{0,2}[0-9])++"
NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?:\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}++){1,3}+"
KINDS = ("email", "ip", "card", "phone", "handle", "iban", "ssn", "number", "name")
#: All forms in one scan; a digit sequence of an address or a phone number isn't met again as a number.
ANY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, HANDLE, IBAN, SSN, NUMBER, NAME))

# Gazetteers.
GIVEN = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Lisa|Matthew|Nancy|Anthony|Mark|Paul|Steven|Andrew|Emily|Anna|Peter|Hans|Klaus|Stefan|Andreas|Sabine|Ursula|Monika|Petra|Claudia|Jean|Pierre|Michel|Marie|Nathalie|Isabelle|Philippe|Sophie|Camille|Antoine|Jose|Juan|Carlos|Luis|Javier|Miguel|Ana|Carmen|Lucia|Pablo|Diego|Sofia|Laura|Elena|Alice|Julia|Martin|Simon|Lucas|Emma"
NOT_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|License|Licence|Public|General|University|Street|Avenue|Road|City|County|River|Mount|North|South|East|West|New|The|United|States|Kingdom|Republic|Company|Corporation|Foundation|Institute|Department|Version|Chapter|Section|Table|Figure"
TLDS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl|be|jp|cn|in|br|au|ru|pl|se"
DIAL = r"\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
RESERVED = r"(?:0|127|255|22[4-9]|23\d|24\d|25\d)\."
COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
CUES = "phone|tel|telephone|mobile|cell|fax|call|contact|e-?mail|mail|write to|reach|name|mr|mrs|ms|dr|signed|sincerely|regards|dear|born|ssn|social security|passport|iban|account|card|ip|from|telefon|handy|anruf|konto|herr|frau|correo|llamar|móvil|cuenta|señora?|appel\\w*|compte|monsieur|madame"
ANTICUES = "order|invoice|isbn|issn|doi|version|release|page|pages|figure|chapter|section|table|no|nr|serial|part|item|sku|price|total|euro?|usd|line|row|build|commit|id|bestellung|rechnung|seite|pedido|factura|página|commande|facture"

#: Characters of context on either side of a candidate, up to the next one.
CONTEXT = 40
#: Labelers, each of which votes 1 (personal data), -1 or 0 (abstains).
LABELERS = ("form", "gazetteer", "cue", "anticue", "edges")
#: What EM starts from and, in so many counts, holds on to: labelers' accuracy, and the share of personal data among base and other kinds.
START_ACCURACY, START_SHARE, START_COUNTS = 0.8, {True: 0.9, False: 0.1}, 10.0
ROUNDS, TRAIN_ROUNDS = 50, 300
#: Candidates of this probability or more are added.
LEAST = 0.8


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), for which x is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(lengths: Column) -> Column:
    """Sums of what stands before each entry. Blocks of about the root of the array's length keep appended arrays short."""
    zero = F.lit(0)
    add = lambda start, xs: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return let(size, lambda s: F.transform(F.sequence(zero, F.floor((F.size(xs) - 1) / s).cast("int")), lambda b: F.slice(xs, b * s + 1, s)))

    def starts(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return let(add(zero, totals), lambda at: F.flatten(F.transform(bs, lambda b, i: F.slice(add(at[i], b), 1, F.size(b)))))

    return let(lengths, lambda xs: let(blocks(xs), starts))


def found(text: Column, pattern: str, places: bool = True) -> Column:
    """An array of the leftmost non-overlapping matches: hit, what stands left and right of it up to the next match, and with places
    its start and end in code points. Matches and what is between them put the text together again, so lengths give places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"

    def around(h: Column) -> Column:
        def located(g: Column) -> Column:
            if not places:
                return F.transform(h, lambda x, i: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), x.alias("hit"), F.right(g[i], F.lit(CONTEXT)).alias("left"), F.left(g[i + 1], F.lit(CONTEXT)).alias("right")))
            at = running(F.transform(h, lambda x, i: F.length(g[i]) + F.length(x)))
            return let(at, lambda s: F.transform(h, lambda x, i: F.struct(
                (s[i] + F.length(g[i])).alias("start"), (s[i] + F.length(g[i]) + F.length(x)).alias("end"), x.alias("hit"),
                F.right(g[i], F.lit(CONTEXT)).alias("left"), F.left(g[i + 1], F.lit(CONTEXT)).alias("right"))))

        return F.when(F.size(h) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), located))

    return let(hits, around)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid_ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def valid_card(x: Column) -> Column:
    return let(digits(x), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def valid_phone(x: Column) -> Column:
    return F.length(digits(x)).between(9, 15)


VALID = {"email": lambda x: F.lit(True), "ip": valid_ip, "card": valid_card, "phone": valid_phone}
#: What every match of a base pattern holds; texts without it aren't scanned.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(text: Column) -> Column:
    """(start, order, end, kind) of the base patterns' matches that are valid, sorted."""
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def of(order: int, kind: str) -> Column:
        valid = F.filter(found(text, BASE[kind]), lambda m: VALID[kind](m["hit"]))
        spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(none) if HINTS[kind] else spans

    parts = [of(i, k) for i, k in enumerate(BASE)]
    return F.sort_array(F.concat(*parts))


def mod97(iban: Column) -> Column:
    """The remainder of an account number with its first four characters at the end and letters as 10 to 35."""
    x = F.regexp_replace(iban, " ", "")
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda r, c: (F.when(c <= "9", r * 10).otherwise(r * 100) + value(c)) % 97)


def kind_of(hit: Column) -> Column:
    """The kind of a match of ANY; null for what can't be one: sequences of under seven digits."""
    full = lambda p: hit.rlike(f"^(?:{p})$")
    n = F.length(digits(hit))
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(hit.startswith("+"), F.when(n >= 7, F.when(valid_phone(hit), "phone").otherwise("number")))
        .when(full(r"[0-9]+(?:\.[0-9]+){3}"), F.when(valid_ip(hit), "ip").when(n >= 7, "number"))
        .when(hit.rlike("(?i)[\\])\\x20]dot|\\[dot|\\(dot"), "handle")
        .when(full("[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), "iban")
        .when(full("[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(hit.rlike("^\\p{Lu}"), "name")
        .when(full(CARD) & valid_card(hit), "card")
        .when(n >= 7, "number")
    )


def votes(kind: Column, hit: Column, left: Column, right: Column) -> dict[str, Column]:
    """What each labeler says."""
    says = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(-1)
    full = lambda p: hit.rlike(f"^(?:{p})$")
    form = (
        F.when(kind.isin("email", "ip", "card", "phone"), 1)
        .when(kind == "handle", says(hit.rlike(r"[\[(]"), F.lit(False)))
        .when(kind == "iban", says(mod97(hit) == 1))
        .when(kind == "ssn", says(full("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")))
        .when(kind == "number", says(full(r"\(?[0-9]{2,5}\)?[\x20.-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,2}")))
        .otherwise(says(hit.rlike(r"\x20\p{Lu}\."), F.lit(False)))
    )
    gazetteer = (
        F.when(kind.isin("email", "handle"), says(hit.rlike(f"(?i)[^a-z0-9-](?:{TLDS})$")))
        .when(kind == "phone", says(hit.rlike(f"^{DIAL}")))
        .when(kind == "card", says(hit.rlike(f"^{ISSUERS}")))
        .when(kind == "ip", says(~hit.rlike(f"^{RESERVED}")))
        .when(kind == "iban", says(hit.rlike(f"^(?:{COUNTRIES})")))
        .when(kind == "name", F.when(hit.rlike(f"\\b(?:{NOT_NAMES})\\b"), -1).when(hit.rlike(f"^(?:{GIVEN})\\b"), 1).otherwise(-1))
        .otherwise(0)
    )
    near = lambda words: left.rlike(f"(?iU)(?<!\\w)(?:{words})(?!\\w)[^\\n]{{0,16}}$")
    return {
        "form": form,
        "gazetteer": gazetteer,
        "cue": says(near(CUES), F.lit(False)),
        "anticue": F.when(near(ANTICUES), -1).otherwise(0),
        "edges": F.when(left.rlike(r"[\p{L}\p{N}_/#$%=\\.-]$") | right.rlike(r"^(?:[\p{L}\p{N}_/#$%=\\]|[.-]\p{N})"), -1).otherwise(0),
    }


def features(kind: Column, hit: Column, right: Column, said: dict[str, Column]) -> dict[str, Column]:
    """What the classifier sees, each a small set of values: the votes, kind, counts of digits and characters, separators, what follows."""
    n = F.length(digits(hit))
    own = {
        "kind": kind,
        "digits": F.when(n == 0, "none").when(n < 7, "few").when(n < 9, "7").when(n < 12, "9").when(n < 16, "12").otherwise("16"),
        "chars": F.when(F.length(hit) < 12, "short").when(F.length(hit) < 24, "mid").otherwise("long"),
        "parts": F.least(F.size(F.split(hit, r"[^\p{L}\p{N}]+")), F.lit(6)).cast("string"),
        "next": F.when(right == "", "end").when(right.rlike(r"^\s"), "space").when(right.rlike(r"^\p{Punct}"), "mark").otherwise("other"),
    }
    return own | {name: v.cast("string") for name, v in said.items()}


FEATURES = ("kind", "digits", "chars", "parts", "next", *LABELERS)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (features of a candidate, n): how often each combination of features occurs in docs. All are bounded sets."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    each = docs.select(F.explode(found(text, ANY, places=False)).alias("m")).select("m.hit", "m.left", "m.right").withColumn("kind", kind_of(F.col("hit"))).where("kind is not null")
    said = votes(F.col("kind"), F.col("hit"), F.col("left"), F.col("right"))
    return each.select(*[v.alias(k) for k, v in features(F.col("kind"), F.col("hit"), F.col("right"), said).items()]).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"))


def group_of(kind: str) -> str:
    """Kinds of which a labeler's votes are equally reliable: base kinds are one group, as their forms are checked; of others each is one."""
    return "base" if kind in BASE else kind


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, int], float]]:
    """(share of personal data by kind, accuracy by group of kinds and labeler) by expectation-maximisation.

    patterns: kind, votes and count of candidates alike. A labeler that votes is right with its accuracy, and labelers are independent
    given the truth. Accuracies stay between 0.55 and 0.99, as the signs of votes say which of the two classes is which.
    """
    share = {k: START_SHARE[k in BASE] for k, _, _ in patterns}
    start = dict(share)
    accuracy = {(group_of(k), i): START_ACCURACY for k in share for i in range(len(LABELERS))}
    for _ in range(rounds):
        right, cast = dict.fromkeys(accuracy, START_COUNTS * START_ACCURACY), dict.fromkeys(accuracy, START_COUNTS)
        yes, total = {k: START_COUNTS * x for k, x in start.items()}, dict.fromkeys(share, START_COUNTS)
        for kind, vote, n in patterns:
            p = posterior(share, accuracy, kind, vote)
            yes[kind] += n * p
            total[kind] += n
            for i, v in enumerate(vote):
                if v:
                    right[group_of(kind), i] += n * (p if v > 0 else 1 - p)
                    cast[group_of(kind), i] += n
        accuracy = {x: min(0.99, max(0.55, right[x] / cast[x])) for x in accuracy}
        share = {k: min(0.99, max(0.001, yes[k] / total[k])) for k in share}
    return share, accuracy


def posterior(share: dict[str, float], accuracy: dict[tuple[str, int], float], kind: str, vote: tuple[int, ...]) -> float:
    """Probability of personal data, given the votes."""
    odds = math.log(share[kind] / (1 - share[kind]))
    for i, v in enumerate(vote):
        a = accuracy[group_of(kind), i]
        odds += v * math.log(a / (1 - a))
    return 1 / (1 + math.exp(-odds))


def fit(patterns: list[tuple[tuple[str, ...], float, int]], rounds: int = TRAIN_ROUNDS, rate: float = 2.0, l2: float = 1e-4) -> tuple[dict[tuple[str, str], float], float]:
    """(weights by feature and value, bias) of a logistic regression on posteriors, by gradient steps with momentum.

    patterns: feature values, posterior and count. Counts enter by their roots, so that the commonest form doesn't drown the others.
    """
    names = sorted({(f, v) for values, _, _ in patterns for f, v in zip(FEATURES, values)})
    place = {x: i for i, x in enumerate(names)}
    rows = [([place[f, v] for f, v in zip(FEATURES, values)], p, math.sqrt(n)) for values, p, n in patterns]
    total = sum(w for *_, w in rows) or 1.0
    weights, speed = [0.0] * (len(names) + 1), [0.0] * (len(names) + 1)
    for _ in range(rounds):
        slope = [l2 * w for w in weights]
        for at, p, w in rows:
            z = weights[-1] + sum(weights[i] for i in at)
            off = w / total * (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - p)
            slope[-1] += off
            for i in at:
                slope[i] += off
        speed = [0.9 * s - rate * 0.1 * g for s, g in zip(speed, slope)]
        weights = [w + s for w, s in zip(weights, speed)]
    return {x: weights[i] for x, i in place.items()}, weights[-1]


def train(docs: DataFrame, text_col: str = "text") -> tuple[dict[tuple[str, str], float], float]:
    """The span classifier of docs. Candidates of all documents are counted in Spark by their features; the driver gets one row a
    combination, of which there are at most as many as the features' values allow, and weighs and fits on these counts."""
    rows = sorted(tuple(r) for r in candidates(docs, text_col).collect())
    patterns = [(r[0], tuple(int(x) for x in r[-1 - len(LABELERS) : -1]), r[-1]) for r in rows]
    share, accuracy = reliabilities(patterns)
    return fit([(r[:-1], posterior(share, accuracy, k, v), n) for r, (k, v, n) in zip(rows, patterns)])


def score(model: tuple[dict[tuple[str, str], float], float], values: dict[str, Column]) -> Column:
    """The classifier's log odds."""
    weights, total = model[0], F.lit(model[1])
    for name, value in values.items():
        term = F.lit(0.0)
        for (f, v), w in weights.items():
            if f == name:
                term = F.when(value == v, F.lit(w)).otherwise(term)
        total = total + term
    return total


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, model=None) -> DataFrame:
    """Rows (id_col, base, added) for every row of docs; both arrays of (start, order, end, kind), sorted, in code points.

    base: the fixed patterns' valid matches. added: candidates of the other kinds to which the classifier, trained on all of docs
    unless a model is given, gives the probability least or more. Null texts are empty; repeated rows give repeated results; other
    columns aren't read. Nothing but counts of feature combinations is shuffled.
    """
    if model is None:
        model = train(docs, text_col)
    bar, others = math.log(least / (1 - least)), list(KINDS[len(BASE):])
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def judged(m: Column) -> Column:
        def known(k: Column) -> Column:
            said = votes(k, m["hit"], m["left"], m["right"])
            return F.when(k.isin(others), F.when(score(model, features(k, m["hit"], m["right"], said)) >= bar, k))

        return F.struct(m["start"].alias("start"), m["end"].alias("end"), let(kind_of(m["hit"]), known).alias("kind"))

    kept = F.filter(F.transform(found(F.col("text"), ANY), judged), lambda x: x["kind"].isNotNull())
    orders = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), orders[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.select(F.col("id").alias(id_col), base_spans(F.col("text")).alias("base"), added.alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    spans = find_personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
