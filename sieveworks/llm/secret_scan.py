"""Secrets in texts, with the parts of a credential linked by where they stand.

Some spans are secrets by themselves: a value assigned to a word such as ``password``, an
access identifier, a long run of hexadecimal digits. Others are weak candidates: a short
value, a name of a user, a mixed run of characters, a host. A weak candidate is reported
only where parts that complete it stand near: a secret needs an identifier or an
endpoint, and those need a secret, in the same scope (lines without an empty one between)
and within :data:`REACH` characters.

The intervals are joined as a sweep: of each role only the nearest interval on either
side decides, so every candidate compares with four others at most and no pairs are made.
All expressions are built-in ones. A text is scanned once; only texts that can have a
link give rows to the sweep, and copies of a text one among them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.sources.storage import written

#: Most characters between two parts of a credential.
REACH = 200
#: Values that are running sums together; a text with many matches takes several runs.
_RUN = 256


def _words(*words: str) -> str:
    """Any of some words; letters in either case."""
    return "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words) + ")"


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""

# The patterns that are secrets by themselves.
ASSIGN = "(" + _words("password", "passwd", "secret", "token", "api_?key")[3:-1] + ")" + _GIVEN + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Weak candidates and the empty lines that end a scope, as one pattern; the leftmost counts, and of several at one place the first.
BREAK = r"\n[\x20\t\r]*\n"
URL = r"""https?://[^\x00-\x20"'<>]+"""
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
HOST = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?"
NAMED = _words("user_?name", "user_?id", "user", "login", "account", "client_?id", "access_?key_?id", "access_?key") + _GIVEN
IDENTIFIER = NAMED + "[A-Za-z0-9_.@-]{3,64}"
WEAK = _words("passphrase", "password", "passwd", "pass", "pwd", "pin", "secret", "token", "api_?key", "auth", "key", "credential") + _GIVEN + "[A-Za-z0-9+/_.=-]{4,}"
MIXED = "[A-Za-z0-9+/_-]{20,}"
EVENT = "|".join((BREAK, URL, MAIL, HOST, IDENTIFIER, WEAK, MIXED))
#: What stands in every text with an identifier or an endpoint.
OTHER_PART = "|".join(("://", "@", r"[0-9]\.[0-9]{1,3}\.", "AKIA", NAMED))

#: Kinds of spans in the order in which they stand at one place, and the part of a credential that each is.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
_BREAK = len(KINDS)
_SECRETS, _IDENTIFIERS, _ENDPOINTS = (0, 2, 4), (1, 3), (5,)


def _scanned(rows: DataFrame, **patterns: str) -> DataFrame:
    """An array of (start, end, match) for each pattern: its leftmost matches in ``text`` that don't overlap, in characters.

    What stands between matches and the matches themselves are as long as the text, so
    sums of lengths are the places; they run in two levels, so that thousands of matches
    aren't copied for each.
    """
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()} | {f"p_{k}": F.transform(F.split("text", p, -1), lambda x: F.length(x).cast("long")) for k, p in patterns.items()})
    rows = rows.withColumns({f"w_{k}": F.zip_with(F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")), f"m_{k}", lambda p, m: p + F.length(m)) for k in patterns})
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def run(values: Column, width) -> Column:
        return F.aggregate(values, none, lambda s, x: F.struct((s["total"] + width(x)).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    def runs(widths: Column) -> Column:
        begins = F.when(F.size(widths) > 0, F.sequence(F.lit(1), F.size(widths), F.lit(_RUN))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: run(F.slice(widths, i, F.lit(_RUN)), lambda w: w))

    rows = rows.withColumns({f"r_{k}": runs(F.col(f"w_{k}")) for k in patterns})
    rows = rows.withColumns({f"w_{k}": F.flatten(F.zip_with(f"r_{k}", run(F.col(f"r_{k}"), lambda r: r["total"])["before"], lambda r, o: F.transform(r["before"], lambda x: x + o))) for k in patterns})

    def place(k: str) -> Column:
        def one(before: Column, i: Column) -> Column:
            start, match = before + F.get(F.col(f"p_{k}"), i), F.get(F.col(f"m_{k}"), i)
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))

        return F.transform(f"w_{k}", one)

    return rows.withColumns({k: place(k) for k in patterns}).drop(*(f"{x}_{k}" for k in patterns for x in "mpwr"))


def _spans(places: Column, kind: Column | int) -> Column:
    """(start, rank of the kind, end) of each place; ``kind`` may be a function of the match."""
    rank = kind if callable(kind) else lambda _: F.lit(kind)
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), rank(x["match"]).alias("kind"), x["end"].alias("end")))


def _kind_of(match: Column) -> Column:
    """The rank of a weak candidate's kind, that of a break, or null for a run that isn't mixed."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    mixed = functools.reduce(Column.__and__, (match.rlike(c) for c in ("[0-9]", "[A-Z]", "[a-z]")))
    return (
        F.when(match.startswith("\n"), _BREAK)
        .when(match.rlike("^https?://") | whole(HOST), KINDS.index("endpoint"))
        .when(whole(MAIL) | match.rlike(f"^{NAMED}"), KINDS.index("id"))
        .when(match.rlike("[:=]") | mixed, KINDS.index("secret"))
    )


def linked(events: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, kind, start, end) of the weak candidates in ``events`` (the same columns) that parts of a credential complete.

    Candidates that overlap a span which is a secret by itself are part of it and count
    neither as candidates nor as parts. One text's rows lie in one task.
    """
    text = Window.partitionBy("key").orderBy("start")
    back = Window.partitionBy("key").orderBy(F.desc("start"))
    base = F.col("kind") <= 2
    covered = (F.max(F.when(base, F.col("end"))).over(text) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(back) < F.col("end"))
    rows = events.select("*", F.sum((F.col("kind") == _BREAK).cast("int")).over(text).alias("scope"), F.coalesce(covered, F.lit(False)).alias("covered"))
    rows = rows.where((F.col("kind") != _BREAK) & (base | ~F.col("covered")))
    before = Window.partitionBy("key", "scope").orderBy("start")
    after = Window.partitionBy("key", "scope").orderBy(F.desc("start"))

    def near(kinds: tuple[int, ...]) -> Column:
        mine = F.col("kind").isin(*kinds)
        one = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before) <= reach
        two = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end") <= reach
        return F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))

    rows = rows.select("*", near(_SECRETS).alias("secret"), near(_IDENTIFIERS + _ENDPOINTS).alias("other"))
    complete = F.when(F.col("kind") == KINDS.index("secret"), F.col("other")).otherwise(F.col("secret"))
    return rows.where((F.col("kind") > 2) & complete).select("key", "kind", "start", "end")


def secret_scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_linked, base, spans) of every whole text.

    ``base`` holds (kind, start, end) of spans that are secrets by themselves, in order
    of start and kind, ``spans`` those and the linked candidates; places count characters
    from 0, ends are exclusive. A null text counts as empty and has none. Rows that
    repeat give the same row again; ids may be null; other columns don't matter. A very
    long text is scanned whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # runs of 16 digits and letters, and the others of their kind, are what is left of all runs when shorter ones fall out
    rows = _scanned(rows, assign=ASSIGN, access=f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", hex=f"[0-9a-f]{{{LEAST_HEX},}}")
    assigned = F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= LEAST_VALUE)
    rows = rows.withColumn("assign", assigned)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.array_sort(F.concat(*(_spans(F.col(k), i) for i, k in enumerate(("assign", "access", "hex")))))
    # texts without another part than secrets have no link, and needn't be scanned for candidates
    asked = F.when(F.col("text").rlike(OTHER_PART), F.col("text")).otherwise("")
    rows = rows.select("doc_id", F.md5("text").alias("key"), *counts, base.alias("base"), asked.alias("text"))
    weak = F.filter(_spans(F.col("event"), _kind_of), lambda x: x["kind"].isNotNull())
    found = _scanned(rows, event=EVENT).withColumn("weak", weak)
    some = lambda kinds: F.exists("weak", lambda x: x["kind"].isin(*kinds)) | F.exists("base", lambda x: x["kind"].isin(*kinds))
    candidates = F.exists("weak", lambda x: x["kind"] != _BREAK)
    asked = candidates & some(_SECRETS) & some(_IDENTIFIERS + _ENDPOINTS)
    table = written(found.select("doc_id", "key", "n_assign", "n_access", "n_hex", "base", F.when(asked, F.col("weak")).alias("weak")))
    once = table.where("weak is not null").groupBy("key").agg(F.first(F.concat("base", "weak")).alias("event"))
    events = once.select("key", F.explode("event").alias("e")).select("key", "e.kind", "e.start", "e.end")
    links = linked(events, reach).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("links"))
    rows = table.join(links, "key", "left")
    none = F.array().cast(links.schema["links"].dataType)
    both = F.array_sort(F.concat("base", F.coalesce("links", none)))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.size(F.coalesce("links", none)).cast("long").alias("n_linked"), _named(F.col("base")).alias("base"), _named(both).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_places(kind: str, pattern: str) -> str:
    return f"""
        select r, {kind} as kind, s::bigint as start, (s + length(m))::bigint as "end", m from (
          select r, m, sum(p) over (partition by r order by i) + coalesce(sum(length(m)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as s from (
            select r, unnest(ms) as m, unnest(list_transform(list_slice(string_split_regex(t, {_sql(pattern)}), 1, len(ms)), lambda x: length(x))) as p, unnest(range(len(ms))) as i
            from (select r, t, regexp_extract_all(t, {_sql(pattern)}) as ms from texts)))"""


#: The query as DuckDB SQL.
ORACLE_SQL = f"""
    with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    base as (
      select * from ({_sql_places("0", ASSIGN)}) where length(regexp_extract(m, {_sql(ASSIGN)}, 2)) >= {LEAST_VALUE}
      union all select * from ({_sql_places("1", ACCESS)}) where length(m) >= {LEAST_ACCESS}
      union all select * from ({_sql_places("2", HEX)}) where length(m) >= {LEAST_HEX}
    ), events as (
      select r, kind, start, "end" from base
      union all
      select r, case when starts_with(m, chr(10)) then {_BREAK}
          when regexp_matches(m, '^https?://') or regexp_full_match(m, {_sql(HOST)}) then 5
          when regexp_full_match(m, {_sql(MAIL)}) or regexp_matches(m, {_sql("^" + NAMED)}) then 3
          when regexp_matches(m, '[:=]') or regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') then 4 end, start, "end"
      from ({_sql_places("9", EVENT)})
    ), scoped as (
      select *, count(*) filter (kind = {_BREAK}) over (partition by r order by start) as scope,
        max("end") filter (kind <= 2) over (partition by r order by start) as base_end, min(start) filter (kind <= 2) over (partition by r order by start desc) as base_start
      from events where kind is not null
    ), apart as (
      select r, kind, start, "end", scope from scoped where kind <= 2 or kind <> {_BREAK} and coalesce(base_end <= start, true) and coalesce(base_start >= "end", true)
    ), spans as (
      select r, kind, start, "end" from base
      union all
      select r, kind, start, "end" from apart a where kind > 2 and exists (
        select 1 from apart b where b.r = a.r and b.scope = a.scope and b.start - a."end" <= {REACH} and a.start - b."end" <= {REACH}
          and case a.kind when 4 then b.kind in (1, 3, 5) else b.kind in (0, 2, 4) end)
    ), named as (
      select r, kind, concat_ws(':', {list(KINDS)}[kind + 1], start, "end") as name, start from spans
    ), listed as (
      select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c, count(*) filter (kind > 2) as d,
        coalesce(string_agg(name, ',' order by start, kind) filter (kind <= 2), '') as base, string_agg(name, ',' order by start, kind) as spans
      from named group by r
    )
    select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, coalesce(d, 0) as n_linked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from texts left join listed using (r)"""
