"""URL filters: fixed host and path rules, and association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

# Fixed values: (verdict, host, path) rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Least part of the labelled URLs that hold a token combination with the bad label, and least part of those holding the
#: combination that have the label.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Least number of bad URLs that hold a combination, whatever the part: in a few labelled URLs any token stands in bad ones only by chance.
LEAST_URLS = 10
#: Rules sent to the executors at once; more are matched in further passes.
PASS_RULES = 100_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://; empty where there is none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are part of the plan, so their list is to be short."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path, names in the query; digits become 0."""
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    mark = lambda kind, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind), F.regexp_replace(w, r"\d+", "0")))
    host = mark("host:", F.split(host_of(url), r"\."))
    path = mark("path:", F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}-]+"))
    names = mark("query:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(host, path, names))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS) -> DataFrame:
    """Rules (tokens, confidence, support) from rows (tokens, bad boolean): combinations that go with the bad label more often than
    bad URLs do among all, pruned by confidence and support, and by dropping those that hold a shorter rule.

    What FP-growth sees is made small first, without changing which minimal rules there are: tokens of too few bad URLs can't be
    in a rule; a token that is a rule by itself is in no other; and tokens that stand in the same URLs always are one token, for
    which the least of them stands in longer rules. So any number of equal URLs, however long, adds one token.
    """
    rows = cut(labelled.where("tokens is not null and size(tokens) > 0").select("tokens", F.col("bad").cast("int").alias("bad"), F.monotonically_increasing_id().alias("at")))
    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n_bad:
        return rows.select("tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    support = max(support, (least_urls - 0.5) / n)
    each = rows.select(F.explode("tokens").alias("token"), "bad", "at")
    where = [F.sum(F.xxhash64(F.lit(k), "at").cast("decimal(38,0)")).alias(f"w{k}") for k in (0, 1)]
    counted = cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"), *where).where(F.col("n_bad") >= F.lit(support * n)))
    is_rule = (F.col("n_bad") / F.col("n") >= confidence) & (F.col("n_bad") / F.col("n") > F.lit(n_bad / n))
    single = counted.where(is_rule).select(F.array("token").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"))
    left = counted.where(~is_rule).groupBy("n", "w0", "w1").agg(F.min("token").alias("token")).select("token")
    items = each.join(left, "token").groupBy("at").agg(F.collect_set("token").alias("tokens"), F.max("bad").alias("bad"))
    # URLs without a token left still count as URLs
    items = rows.select("at", F.col("bad").alias("own")).join(items.drop("bad"), "at", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "own")
    items = items.select(F.when(F.col("own") > 0, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") > 1))
    found = cut(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    return single.union(match(found, found, strict=True).where("mined is null").drop("mined"))


class RuleIndex:
    """Rules by one token each, the one that fewest rules hold: a URL looks its tokens up and compares only those rules."""

    def __init__(self, rules: list[tuple[str, ...]]):
        held = Counter(t for r in rules for t in r)
        self.by: dict[str, list[frozenset[str]]] = defaultdict(list)
        for r in rules:
            self.by[min(r, key=lambda t: (held[t], t))].append(frozenset(r))

    def first(self, tokens: list[str], strict: bool = False) -> str | None:
        """The least of the rules that fit, in a fixed order; strict: of those with fewer tokens."""
        own = set(tokens)
        fit = [sorted(r) for t in own for r in self.by.get(t, ()) if (r < own if strict else r <= own)]
        return " ".join(min(fit, key=lambda r: (len(r), r))) if fit else None


def match(urls: DataFrame, rules: DataFrame, pass_rules: int = PASS_RULES, strict: bool = False) -> DataFrame:
    """Add a column `mined` to rows with a column `tokens`: the tokens of the least mined rule that fits (strict: and that has fewer
    tokens), or null.

    Rules are counted first and sent in blocks of bounded size; each pass over the rows keeps what earlier ones found.
    """
    spark = urls.sparkSession
    rules = rules.select("tokens")
    n = max(1, -(-2 * rules.count() // pass_rules)) if pass_rules else 1
    schema = T.StructType([*urls.schema.fields, T.StructField("mined", T.StringType())])
    out = urls.withColumn("mined", F.lit(None).cast("string"))
    at = urls.columns.index("tokens")
    for k in range(n):
        block = [tuple(r["tokens"]) for r in rules.where(F.pmod(F.xxhash64("tokens"), F.lit(n)) == k).toLocalIterator()]
        if not block:
            continue
        sent = spark.sparkContext.broadcast(sorted(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(sent.value)
            for batch in batches:
                had = batch.column(batch.num_columns - 1).to_pylist()
                new = [index.first(x or [], strict) for x in batch.column(at).to_pylist()]
                both = [min((x for x in p if x is not None), key=lambda x: (x.count(" "), x), default=None) for p in zip(had, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(both, pa.string())], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, mined) for every row of pages. labels: (id, bad boolean); an id with several labels
    is bad if one says so, rows without a label teach nothing.

    The longest fixed rule that fits decides; else a URL that a mined rule fits is blocked, and all others are allowed. Null URLs
    and those without :// have empty host and path, and no tokens. Only the url column is read, and pages are not shuffled to be
    judged; mining joins ids with labels and counts token combinations in Spark.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    known = labels.where("bad is not null and id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = rows.join(known, "id").select("tokens", "bad")
    found = match(rows, mine(labelled, support, confidence))
    fixed = rule_of(F.col("host"), F.col("path"), rules)
    out = found.withColumn("fixed", fixed)
    verdict = F.coalesce("fixed.verdict", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") > 0) | (F.col("quality") == 0)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


#: The fixed rules in SQL. No combination of tokens reaches support and confidence in tables whose labels don't depend on URLs, so
#: `mined` is null there.
OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM cut, rules
  WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS mined
FROM cut LEFT JOIN fits USING (page_id)
"""
