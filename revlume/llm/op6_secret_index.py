"""Secret scans through an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: every match of the rule
holds all trigrams of at least one branch.  The texts are read once to build the postings of the
trigrams that any rule asks for; intersecting postings gives each rule the texts that can match, and
only those are searched with the expression itself.  A rule without mandatory trigrams is searched for
in every text.

Only DataFrame functions are used.  Postings name a text by its hash, so copies share one entry (two
texts with the same hash only make a candidate more), and the matches are always taken from the text.
Candidates are broadcast up to a counted bound and joined over salted keys beyond it.

Defined results: a null or empty text has no spans; copies and repeated rows each get their row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops, _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlume.session import staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match whose ``group`` is shorter than ``least`` is dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The three base kinds in their order, then further public token formats.  Where every
# match is a whole run of its class, the least length is part of the expression.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8, base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"ghp_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)

MAX_BROADCAST_ROWS = 200_000
SALTS = 32
#: Matches of one text that are laid out together; keeps the work per match the same for any number.
CHUNK = 256

_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint>>"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of lower-case trigrams, one of which is whole in every match; none if nothing is mandatory."""
    branches = [trigrams for trigrams, _ in _follow(parser.parse(pattern), [(frozenset(), "")])]
    if not all(branches):
        return []
    return sorted({b for b in branches if not any(o < b for o in branches)}, key=sorted)


def _follow(nodes, states: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
    """States (trigrams so far, literal text just before) after a sequence of parsed nodes."""
    for op, value in nodes:
        if op is ops.LITERAL:
            grown = [(trigrams, (tail + chr(value).lower())[-3:]) for trigrams, tail in states]
            states = [(t | {tail} if len(tail) == 3 else t, tail) for t, tail in grown]
        elif op is ops.SUBPATTERN:
            states = _follow(value[3], states)
        elif op is ops.BRANCH:
            states = [s for option in value[1] for s in _follow(option, states)]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, inner = value
            once = _follow(inner, states)
            if most == 1:
                states = once if least else [*states, *once]
            else:
                states = [(t, "") for t, _ in (once if least else states)]
        elif op is not ops.AT:
            states = [(trigrams, "") for trigrams, _ in states]
        states = list(dict.fromkeys(states))
    return states


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (``gram``, ``key``) of the trigrams that the rules ask for; ``docs`` has ``text``."""
    grams = sorted({g for rule in rules for branch in trigram_query(rule.pattern) for g in branch})
    low = docs.select(_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams)))
    return staged(low.select("key", F.explode(present).alias("gram")), "op6-postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each text that some rule can match: ``key`` and the numbers of those rules."""
    wanted = [
        (n, b, gram, place, len(branch))
        for n, rule in enumerate(rules)
        for b, branch in enumerate(trigram_query(rule.pattern))
        for place, gram in enumerate(sorted(branch))
    ]
    spark = index.sparkSession
    schema = "rule int, branch int, gram string, place int, need int"
    # As many rows as the rules have trigrams.
    queries = F.broadcast(spark.createDataFrame(wanted, schema))
    seen = F.expr("bit_or(shiftleft(1L, place))")
    met = index.join(queries, "gram").groupBy("key", "rule", "branch").agg(seen.alias("seen"), F.max("need").alias("need"))
    whole = met.where(F.bit_count("seen") == F.col("need"))
    return whole.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """All matches of a rule as (start, number, end) in code points; ``text`` has at least one."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.zip_with(
        F.slice(between, 1, F.size(found)),
        F.arrays_zip(found.alias("found"), checked.alias("checked")),
        lambda gap, m: F.struct(
            F.length(gap).cast("long").alias("gap"),
            F.length(m["found"]).cast("long").alias("size"),
            (F.length(m["checked"]) >= rule.least).alias("good"),
        ),
    )
    # Places are running sums: over the chunks first, then inside each chunk.
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)),
    )
    width = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, p: a + p["gap"] + p["size"])
    empty = F.array().cast(_SPAN)

    def lay(start: Column, chunk: Column) -> Column:
        state = F.struct(start.alias("at"), empty.alias("spans"))

        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + p["gap"]
            end = begin + p["size"]
            span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"))
            added = F.when(p["good"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
            return F.struct(end.alias("at"), added.alias("spans"))

        return F.aggregate(chunk, state, step)["spans"]

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("all"))
    walk = F.aggregate(
        chunks, first,
        lambda a, c: F.struct((a["at"] + width(c)).alias("at"), F.concat(a["all"], F.array(lay(a["at"], c))).alias("all")),
    )
    return F.flatten(walk["all"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``doc_id`` and ``found``, all spans of all rules in order of start and rule."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = staged(candidates(build_index(rows, rules), rules), "op6-candidates")
    rows = rows.withColumn("key", _key(F.col("text")))
    if listed.count() <= max_broadcast_rows:
        rows = rows.join(F.broadcast(listed), "key", "left")
    else:
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(copies, ["key", "salt"], "left")
    none = F.array().cast(_SPAN)
    parts = []
    for number, rule in enumerate(rules):
        can = F.col("text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            can = F.coalesce(F.array_contains("rules", number), F.lit(False)) & can
        parts.append(F.when(can, _spans(F.col("text"), rule, number)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def op6_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = F.array(*(F.lit(rule.kind) for rule in RULES))
    base = sum(rule.base for rule in RULES)

    def written(spans: Column) -> Column:
        name = lambda s: F.element_at(kinds, s["kind_no"] + 1)
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind_no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == kind_no)).cast("long")

    found = scan(docs)
    digest = F.sha2(written(F.filter("found", lambda s: s["kind_no"] < base)).cast("binary"), 256)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        digest.alias("base_sha256"), written(F.col("found")).alias("spans"),
    )


def _kind_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, {number} AS kind_no, '{rule.kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (
    SELECT r, m, g, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT r, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
             string_split_regex(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')))
  ) WHERE length(g[i]) >= {rule.least}"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(n, rule) for n, rule in enumerate(RULES))}
), a AS (
  SELECT r, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
