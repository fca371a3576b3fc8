r"""Secret scans: base patterns, and weak parts that count only together.

Three base kinds (assign, access, hex) are reported wherever they stand.  Two
weak kinds are reported only when complementary parts stand within ``SCOPE``
code points: ``key`` (a long mixed token) beside an identifier, an access
identifier or an endpoint; ``id`` (an identifier) beside a key or an assigned
secret.  Parts are joined as intervals: each is dealt to the buckets its scope
touches, and buckets of one text are joined by equality.

DataFrame functions only.  A null text is empty; rows may repeat (parts are
those of a (doc_id, text), so repeated rows get the same spans); doc_id may be
null.  Very long texts: positions come from running sums, containment and
masking from running maxima, in near linear work; cutting out what lies between
the spans looks for each place in the text anew.  Only doc_id and text are read;
``scan`` adds two columns under names that the table must not have, ``redact`` none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .native_spans import find_gated, running_max

SCOPE = 200
#: Base patterns, fixed values.  Keywords in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 8
#: AKIA[A-Z0-9]+ of 16 characters or more, and [0-9a-f]+ of 32 or more: a shorter
#: run holds no longer match, so the bound may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts, fixed values.
IDENTIFIER = r"""([Uu]ser(?:[Nn]ame)?|USER(?:NAME)?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|CLIENT_?ID|[Aa]ccount_?[Ii][Dd]|ACCOUNT_?ID|[Aa]ccess_?[Kk]ey_?[Ii][Dd]|ACCESS_?KEY_?ID)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+)"""
ENDPOINT = r"(https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([A-Za-z0-9._:@/-]+)"
KEY = r"[A-Za-z0-9+/_=-]{24,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "id", "key")
_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


#: A text can hold a match only if its lower-case form holds one of these.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
IDENTIFIER_WORDS = ("user", "login", "client", "account", "access")


def _runs(chars: str, least: int) -> str:
    """A run of ``least`` characters, tried only where a run begins."""
    return f"(?:^|[^{chars}])[{chars}]{{{least}}}"


def gates(low: Column, text: Column) -> dict[str, Column]:
    """Cheap conditions without which a pattern cannot match; ``low`` is the text in lower case."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return {
        "__g_assign": has(ASSIGN_WORDS),
        "__g_id": has(IDENTIFIER_WORDS),
        "__g_access": F.contains(text, F.lit("AKIA")),
        "__g_hex": text.rlike(_runs("0-9a-f", 32)),
        "__g_key": text.rlike(_runs("A-Za-z0-9+/_=-", 24)),
        "__g_endpoint": F.contains(text, F.lit("://")),
    }


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind."""
    assign = find_gated(text, F.col("__g_assign"), ASSIGN, 2)
    return {
        "assign": _named(F.filter(assign, lambda s: F.char_length(s["part"]) >= MIN_ASSIGNED), "assign"),
        "access": _named(find_gated(text, F.col("__g_access"), ACCESS), "access"),
        "hex": _named(find_gated(text, F.col("__g_hex"), HEX), "hex"),
    }


def weak_parts(text: Column) -> Column:
    """Identifiers, endpoints and mixed tokens of a text, as spans with kinds."""
    mixed = F.filter(find_gated(text, F.col("__g_key"), KEY), lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[a-z]") & s["match"].rlike("[A-Z]"))
    return F.concat(
        _named(find_gated(text, F.col("__g_id"), IDENTIFIER), "id"),
        _named(find_gated(text, F.col("__g_endpoint"), ENDPOINT), "endpoint"),
        _named(mixed, "key"),
    )


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _sorted(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak spans with a complementary part in scope; parts: __id, __h, start, end, kind."""
    width = 2 * scope + 256
    bucket = lambda c: F.floor(c / width)
    weak = parts.where("kind IN ('id', 'key')").withColumn("__b", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("end") + scope))))
    other = parts.select(
        F.col("__id").alias("i2"), F.col("__h").alias("h2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("k2"),
        F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("b2"),
    )
    near = (F.col("s2") <= F.col("end") + scope) & (F.col("start") <= F.col("e2") + scope)
    fits = ((F.col("kind") == "key") & F.col("k2").isin("id", "access", "endpoint")) | ((F.col("kind") == "id") & F.col("k2").isin("key", "assign"))
    same = F.col("__id").eqNullSafe(F.col("i2")) & (F.col("__h") == F.col("h2")) & (F.col("__b") == F.col("b2"))
    return weak.join(other, same & near & fits, "left_semi").select("__id", "__h", "start", "end", "kind").distinct()


def _id() -> Column:
    return F.col("doc_id").cast("long")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """__id, __h, __base and __spans of every different (doc_id, text) with a span.

    The texts are read once; what is found in them, a small part, is written to
    the shared folder and linked from there.
    """
    rows = docs.select(_id().alias("__id"), _text().alias("__text")).withColumns({"__h": F.xxhash64("__text"), "__low": F.lower("__text")})
    rows = rows.withColumns(gates(F.col("__low"), F.col("__text"))).where("__g_assign OR __g_access OR __g_hex OR __g_key OR __g_id")
    kinds = base_spans(F.col("__text"))
    found = rows.select("__id", "__h", _sorted(F.concat(*kinds.values())).alias("__base"), weak_parts(F.col("__text")).alias("__weak"))
    found = common.materialise(docs.sparkSession, found.where(F.size("__base") + F.size("__weak") > 0)).distinct()
    strong = F.filter("__base", lambda s: s["kind"].isin("assign", "access"))
    parts = found.where(F.exists("__weak", lambda s: s["kind"].isin("id", "key"))).select("__id", "__h", F.explode(F.concat("__weak", strong)).alias("p"))
    more = _linked(parts.select("__id", "__h", "p.start", "p.end", "p.kind"), scope)
    more = more.groupBy(F.col("__id").alias("i2"), F.col("__h").alias("h2")).agg(F.collect_list(F.struct("start", "end", "kind")).alias("__more"))
    joined = found.join(more, F.col("__id").eqNullSafe(F.col("i2")) & (F.col("__h") == F.col("h2")), "left")
    every = _sorted(F.concat("__base", F.coalesce(F.col("__more"), F.array().cast(_SPANS))))
    joined = joined.select("__id", "__h", "__base", every.alias("__all"))
    # base spans stand before weak ones of the same start, so one that holds a weak span stands before it
    strong = lambda s: s["kind"].isin(*BASE_KINDS)
    to = running_max(F.transform("__all", lambda s: F.when(strong(s), s["end"]).otherwise(F.lit(-1).cast("long"))))
    # zipped and not looked up by index: a lookup in a lambda would work out the whole array for every element
    kept = F.filter(F.zip_with("__all", to, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda x: strong(x["s"]) | (x["m"] < x["s"]["end"]))
    kept = F.transform(kept, lambda x: x["s"])
    return joined.select("__id", "__h", "__base", kept.alias("__spans")).where(F.size("__spans") > 0)


def scan(docs: DataFrame, scope: int = SCOPE, base: str = "__base", spans: str = "__spans") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of start, end, kind); all columns stay."""
    clash = {base.lower(), spans.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; choose other names")
    own = {n: common.fresh(docs, n) for n in ("__i", "__h")}
    found = find_spans(docs, scope).toDF("__id", "__hash", "__of_base", "__of_all")
    left = docs.withColumns({own["__i"]: _id(), own["__h"]: F.xxhash64(_text())}).alias("l")
    same = F.col(f"l.{own['__i']}").eqNullSafe(F.col("r.__id")) & (F.col(f"l.{own['__h']}") == F.col("r.__hash"))
    none = F.array().cast(_SPANS)
    columns = [F.col(f"l.`{c}`") for c in docs.columns]
    return left.join(found.alias("r"), same, "left").select(*columns, F.coalesce("r.__of_base", none).alias(base), F.coalesce("r.__of_all", none).alias(spans))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every run of overlapping spans replaced by ``mask``; n_chars follows where it exists."""
    base, spans, reach, new = (common.fresh(docs, n) for n in ("__base", "__spans", "__reach", "__new"))
    found = scan(docs, scope, base, spans).withColumn(reach, running_max(F.transform(spans, lambda s: s["end"]), 0))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(reach, F.lit(1), F.greatest(F.size(reach) - 1, F.lit(0))))
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    # what lies before each span that begins a run, and its mask; then the rest
    parts = F.zip_with(spans, before, lambda s, m: F.when(s["start"] >= m, F.concat(piece(m, s["start"]), F.lit(mask))).otherwise(F.lit("")))
    rest = piece(F.element_at(reach, -1), F.char_length("text").cast("long"))
    out = found.withColumn(new, F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)))
    changed = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(new).isNotNull(), F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text of documents."""
    found = scan(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(as_text(F.col("__base")), 256).alias("base_sha256"), as_text(F.col("__spans")).alias("spans"))


def _sql_spans(kind: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT k, '{kind}' AS kind, start, start + length(m) AS "end" FROM (
  SELECT k, m[i] AS m, g[i] AS part, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT k, m, g, gap, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT k, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS gap FROM d WHERE regexp_matches(text, '{p}')))) WHERE {keep}"""


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_sql_spans("assign", ASSIGN, f"length(part) >= {MIN_ASSIGNED}", 2)}
UNION ALL {_sql_spans("access", ACCESS)}
UNION ALL {_sql_spans("hex", HEX)}),
weak AS ({_sql_spans("id", IDENTIFIER)}
UNION ALL {_sql_spans("endpoint", ENDPOINT)}
UNION ALL {_sql_spans("key", KEY, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")}),
parts AS (SELECT * FROM weak UNION ALL SELECT * FROM base WHERE kind IN ('assign', 'access')),
linked AS (SELECT * FROM weak w WHERE kind IN ('id', 'key')
  AND EXISTS (SELECT 1 FROM parts p WHERE p.k = w.k AND p.start <= w."end" + {SCOPE} AND w.start <= p."end" + {SCOPE}
    AND ((w.kind = 'key' AND p.kind IN ('id', 'access', 'endpoint')) OR (w.kind = 'id' AND p.kind IN ('key', 'assign'))))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = w.k AND b.start <= w.start AND w."end" <= b."end")),
spans AS (SELECT *, list_position(['assign', 'access', 'hex', 'id', 'key'], kind) AS o, kind || ':' || start || ':' || "end" AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
per AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(s, ',' ORDER BY start, o) FILTER (o <= 3) AS b, string_agg(s, ',' ORDER BY start, o) AS al FROM spans GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans
FROM d LEFT JOIN per USING (k)
"""
