r"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds of spans (assign, access, hex) and one generic kind (long tokens that mix letters and digits) are
found in each whole text. The values are hashed, and each hash is counted over the corpus by distinct owners and
distinct repositories. A value that several owners or many repositories hold is a copied example; one that keeps to
few of both and looks live (letters and digits, many different characters) is owner-specific, and its generic spans
are added as kind `owned`. Base spans always stay; n_owned and n_copied say how many distinct values of the row are of
either sort (a value of few holders that does not look live is neither).

Positions come from the pieces between matches: a match starts after all earlier pieces and matches. They are added
up in runs of RUN matches and then over the runs, so that a text of very many matches costs little more than its length.

A hash that very many rows hold is no hot key: hashes of more than HOT rows, which are few, are joined by hash and a
salt of SALTS values, all others by hash alone.

Cases: null text counts as empty and has no spans; a null owner or repository counts as the empty text; rows of
the same repository and text have the same result, and other rows of that repository their own; texts of any length are
read whole; nothing depends on the order of rows; an empty table gives an empty one; in `scan_secrets` the columns
named in keep are kept, those with an output's name are replaced; `redact` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import marked, materialized, table, whole

#: A value held by more distinct owners than this is a copied example.
MOST_OWNERS = 2
#: So is one held by more distinct repositories than this, even of a single owner.
MOST_REPOS = 10
#: Hashes that more rows hold than this are joined with a salt of so many values.
HOT, SALTS = 1000, 32
#: Matches of one text that are put in place at once.
RUN = 256
#: A live-looking value: least length of a generic token and least number of different characters.
LEAST_LENGTH, LEAST_DISTINCT = 20, 10
KINDS = ("assign", "access", "hex", "owned")
#: Which group of the match is the value, and its least length.
VALUE = {"assign": (2, 12), "access": (0, 18), "hex": (0, 16), "owned": (0, LEAST_LENGTH)}


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base kinds as the contract has them; a run of [0-9a-f]+ of 16 or more characters is a match of [0-9a-f]{16,}, and so for AKIA.
PATTERNS = {
    "assign": rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "owned": r"[A-Za-z0-9+/_=-]{20,}",
}


def matches(text: Column, kind: str) -> Column:
    """array<struct<at, end, value>> of all matches of the kind, without those that are too short."""
    pattern = F.lit(PATTERNS[kind])
    group, least = VALUE[kind]
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(group))
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = "array<struct<at:int,end:int,value:string>>"
    nothing = F.array().cast(found)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))

    def placed(run: Column) -> Column:
        """The matches of one run, from where it starts, and its length."""
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("at"), nothing.alias("found")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["whole"]), F.lit(0))).alias("at"),
                F.when(
                    F.length(p["value"]) >= least,
                    F.concat(
                        s["found"],
                        F.array(F.struct((s["at"] + F.length(p["gap"])).alias("at"), (s["at"] + F.length(p["gap"]) + F.length(p["whole"])).alias("end"), p["value"].alias("value"))),
                    ),
                )
                .otherwise(s["found"])
                .alias("found"),
            ),
        )

    starts = F.aggregate(
        F.transform(runs, placed),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{found}>").alias("found")),
        lambda s, r: F.struct(
            (s["at"] + r["at"]).alias("at"),
            F.concat(s["found"], F.array(F.transform(r["found"], lambda m: F.struct((m["at"] + s["at"]).alias("at"), (m["end"] + s["at"]).alias("end"), m["value"].alias("value"))))).alias("found"),
        ),
        lambda s: F.flatten(s["found"]),
    )
    # most texts have no match: one pass tells
    return F.when(text.rlike(PATTERNS[kind]), starts).otherwise(nothing)


def live_looking(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def spans_of(kinds: tuple[str, ...]) -> Column:
    """The spans of the array columns of these kinds as text: kind:start:end by start, then kind."""

    def placed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["at"].alias("at"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end")))

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(placed, kinds))), lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["at"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the columns in keep, n_assign, n_access, n_hex, base_spans, spans, n_owned, n_copied, most_owners and
    most_repos (the largest counts of any value of the row, 0 without values), `secrets` (array of at, end: what a caller may
    cut out: base spans and owned ones) and `held` (array of hash, live, owners, repos: each value of the row, whether it
    looks live and how many distinct ones hold it)."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(repo).cast("string"), F.lit(""))
    outputs = {"n_assign", "n_access", "n_hex", "base_spans", "spans", "n_owned", "n_copied", "most_owners", "most_repos", "secrets", "held", "key1", "key2"}
    kept = [c for c in dict.fromkeys(keep) if c not in outputs]
    found = docs.select(
        F.struct(*kept).alias("__kept") if kept else F.struct(F.lit(0).alias("none")).alias("__kept"),
        name.alias("__repo"),
        F.xxhash64(name, body).alias("__k1"),
        F.xxhash64(body, name, F.lit(1)).alias("__k2"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("__owner"),
        *[matches(body, k).alias(k) for k in KINDS],
    ).withColumn("owned", F.filter("owned", lambda m: live_looking(m["value"])))
    found = found.withColumns({k: F.transform(k, lambda m: F.struct(m["at"].alias("at"), m["end"].alias("end"), F.sha2(m["value"].cast("binary"), 256).alias("hash"), live_looking(m["value"]).alias("live"))) for k in KINDS})
    found = materialized(found, "secret-candidates")

    def asked_of(kind: str) -> Column:
        span = lambda m: F.struct(m["at"].alias("at"), m["end"].alias("end"))
        return F.transform(kind, lambda m: F.struct(m["hash"].alias("hash"), m["live"].alias("live"), (span(m) if kind == "owned" else F.lit(None).cast("struct<at:int,end:int>")).alias("span")))

    names = ["__repo", "__owner", "__k1", "__k2"]
    held = found.select(*names, F.explode(F.concat(*map(asked_of, KINDS))).alias("h")).select(*names, "h.*")
    held = held.groupBy(*names, "hash", "live").agg(F.collect_set("span").alias("spans"))
    # each step has partial sums before its shuffle, so a hash that is everywhere is counted in many tasks
    by_repo = held.groupBy("hash", "__owner", "__repo").agg(F.count("*").alias("rows"))
    by_owner = by_repo.groupBy("hash", "__owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    frequency = materialized(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("rows").alias("rows")), "secret-counts")
    salted = frequency.where(F.col("rows") > HOT).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("owners").alias("o"), F.col("repos").alias("r"))
    asked = held.groupBy("__k1", "__k2", "hash", "live").agg(F.first("spans").alias("spans")).withColumn("salt", F.pmod("__k2", F.lit(SALTS)).cast("int"))
    asked = asked.join(salted, ["hash", "salt"], "left").drop("salt")
    hot = asked.where(F.col("o").isNotNull()).withColumnsRenamed({"o": "owners", "r": "repos"})
    rest = asked.where(F.col("o").isNull()).drop("o", "r").join(frequency.where(F.col("rows") <= HOT).drop("rows"), "hash")
    few = (F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS)
    verdict = (
        hot.unionByName(rest)
        .groupBy("__k1", "__k2")
        .agg(
            F.flatten(F.collect_list(F.when(few & F.col("live"), F.col("spans")))).alias("__owned"),
            F.count(F.when(few & F.col("live"), 1)).alias("n_owned"),
            F.count(F.when(~few, 1)).alias("n_copied"),
            F.max("owners").alias("most_owners"),
            F.max("repos").alias("most_repos"),
            F.collect_list(F.struct("hash", "live", "owners", "repos")).alias("held"),
        )
    )
    got = found.join(verdict, ["__k1", "__k2"], "left")
    got = got.withColumn("owned", F.coalesce("__owned", F.array().cast("array<struct<at:int,end:int>>")))
    every = F.concat(*[F.transform(k, lambda m: F.struct(m["at"].alias("at"), m["end"].alias("end"))) for k in KINDS])
    return got.select(
        "__kept.*" if kept else F.lit(0).alias("__none"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        spans_of(KINDS[:3]).alias("base_spans"),
        spans_of(KINDS).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_copied", "most_owners", "most_repos")],
        F.array_sort(every).alias("secrets"),
        F.array_sort(F.coalesce("held", F.array().cast(got.schema["held"].dataType))).alias("held"),
        F.col("__k1").alias("key1"),
        F.col("__k2").alias("key2"),
    ).drop("__none")


MASK = "[SECRET]"


def redacted(text: Column, secrets: Column) -> Column:
    """text with each of the spans (array of at, end; sorted) replaced by MASK; spans that overlap make one."""
    done = F.aggregate(
        secrets,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when((x["at"] >= s["at"]), F.concat(s["out"], F.substr(text, s["at"] + 1, x["at"] - s["at"]), F.lit(MASK))).otherwise(s["out"]).alias("out"),
        ),
    )
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def redact(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """docs with all spans of scan_secrets masked in the text; texts without any are not shuffled."""
    found = scan_secrets(docs, text, repo, owner).where(F.size("secrets") > 0).select(F.col("key1").alias("__k1"), F.col("key2").alias("__k2"), F.col("secrets").alias("__secrets")).distinct()
    body, name = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(repo).cast("string"), F.lit(""))
    found = materialized(found, "secrets")
    rows = docs.select(whole(docs).alias("doc"), F.col(text).alias("text"), F.xxhash64(name, body).alias("__k1"), F.xxhash64(body, name, F.lit(1)).alias("__k2"))
    both = marked(rows, "__k1", found.select("__k1"), "maybe")
    rest = both.where("maybe").join(found, ["__k1", "__k2"], "left")
    clean = F.when(F.col("__secrets").isNotNull(), redacted(F.col("text"), F.col("__secrets"))).otherwise(F.col("text"))
    rest = rest.select(*[(clean if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
    return both.where(~F.col("maybe")).select("doc.*").union(rest)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_owned", "n_copied", "most_owners", "most_repos")


def _oracle() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    parts = []
    for order, kind in enumerate(KINDS):
        group, least = VALUE[kind]
        p = quoted[kind]
        value = f"regexp_extract_all(body, '{p}', {group})"
        parts.append(
            f"""SELECT doc_id, body, source, '{kind}' AS kind, {order} AS ord, g.pos AS pos, g.pos + length(g.whole) AS fin, g.val AS val
            FROM (SELECT doc_id, body, source, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'whole': w[i], 'val': v[i],
                    'pos': CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS BIGINT)}})) AS g
                  FROM (SELECT doc_id, body, source, string_split_regex(body, '{p}') AS gaps, regexp_extract_all(body, '{p}', 0) AS w, {value} AS v FROM d)
                  WHERE len(w) > 0) WHERE length(g.val) >= {least}"""
            + (f" AND regexp_matches(g.val, '[0-9]') AND regexp_matches(g.val, '[A-Za-z]') AND len(list_distinct(string_split(g.val, ''))) >= {LEAST_DISTINCT}" if kind == "owned" else "")
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS source FROM documents),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT val, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos,
        regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= {LEAST_DISTINCT} AS live FROM m GROUP BY val),
s AS (SELECT m.*, owners, repos, live, owners > {MOST_OWNERS} OR repos > {MOST_REPOS} AS copied FROM m JOIN f USING (val)),
a AS (SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || pos || ':' || fin, ',' ORDER BY pos, ord) FILTER (ord < 3) AS base,
        string_agg(kind || ':' || pos || ':' || fin, ',' ORDER BY pos, ord) FILTER (ord < 3 OR NOT copied) AS spans,
        count(DISTINCT val) FILTER (live AND NOT copied) AS n_owned, count(DISTINCT val) FILTER (copied) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLES = {"op5_secrets": _oracle()}
