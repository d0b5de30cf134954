"""Joins that decide which records are the same item.

Every join has an equality key; bands and scores are residual conditions on it. An
or-condition is written as one join for each of its keys.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions import keys, similarity, tolerance
from sieveworks.operators.components import connected_components
from sieveworks.sources.storage import forget, written


def coalesced_lookup(left: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], str]], out: str = "found") -> DataFrame:
    """``left`` with ``out`` from the first of ``tables`` (table, keys, value) that has its key, and ``level``, the number of that table (null: none). Human decisions come first, then ids, then keys. Each table is unique by its keys."""
    df = left
    for i, (table, on, value) in enumerate(tables):
        df = df.join(table.select(*on, F.col(value).alias(f"_v{i}")), [*on], "left")
    values = [F.col(f"_v{i}") for i in range(len(tables))]
    level = F.coalesce(*(F.when(v.isNotNull(), i + 1) for i, v in enumerate(values)))
    return df.withColumns({out: F.coalesce(*values), "level": level}).drop(*(f"_v{i}" for i in range(len(tables))))


def library_index(tracks: DataFrame, path: str = "path", artist: str = "artist", album_artist: str = "albumartist", title: str = "title") -> DataFrame:
    """(artist_key, title_key, path): the first path in order for each key, by artist and by album artist."""
    names = F.array_distinct(F.array(keys.artist_key(F.col(artist)), keys.artist_key(F.col(album_artist))))
    rows = tracks.select(F.explode(names).alias("artist_key"), keys.title_key(F.col(title)).alias("title_key"), F.col(path).alias("path"))
    return rows.where("artist_key <> ''").groupBy("artist_key", "title_key").agg(F.min("path").alias("path"))


def missing(wanted: DataFrame, owned: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """The rows of ``wanted`` that no table of ``owned`` (table, keys) has."""
    for table, on in owned:
        wanted = wanted.join(table.select(*on).distinct(), [*on], "left_anti")
    return wanted


def first_of_each(df: DataFrame, keys_in_order: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each value of the first of the keys that a row has; rows without any stay."""
    tagged = F.coalesce(*(F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys_in_order))
    rows = df.withColumn("_key", tagged)
    one = rows.where("_key is not null").withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n")
    return one.unionByName(rows.where("_key is null")).drop("_key")


def majority_path(events: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """For each key the path of most of its events, ties by the path."""
    counts = events.where(F.col(path).isNotNull()).groupBy(*key, path).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(path, F.struct(-F.col("n"), F.col(path))).alias(path))


def novel(candidates: DataFrame, id_col: str, checks: Sequence[tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Candidates of which no key is known; a check is (keys of candidates (id, key), known keys, key)."""
    out = candidates
    for own, known, key in checks:
        hit = own.join(known.select(key).distinct(), key, "left_semi").select(id_col).distinct()
        out = out.join(hit, id_col, "left_anti")
    return out


def band_join(a: DataFrame, b: DataFrame, on: Sequence[str], near: Column, bands: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows of equal keys for which ``near`` holds; the two sides' other columns must differ in name.

    With ``bands``, numbers of the two sides that differ by at most 1 where ``near`` holds,
    the band joins too, so a key with very many rows isn't compared all with all.
    """
    if bands is None:
        return a.join(b, [*on]).where(near)
    a = a.withColumn("_band", bands[0])
    b = b.withColumn("_band", F.explode(F.array(*(bands[1] + i for i in (-1, 0, 1)))))
    return a.join(b, [*on, "_band"]).where(near).drop("_band")


def nearest_other(df: DataFrame, by: Sequence[str], id_col: str, value: str) -> DataFrame:
    """(id, other): for each row of a group of several the other row nearest in ``value``, of equally near ones the smallest id.

    Neighbours in the order of values are enough: rows meet no others.
    """
    rows = df.select(*by, F.col(id_col).alias("id"), F.col(value).alias("v"))
    same = W.partitionBy(*by, "v").orderBy("id")
    two = rows.withColumn("_n", F.row_number().over(same)).where("_n <= 2").groupBy(*by, "v").agg(F.min("id").alias("lo"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("second"))
    order = W.partitionBy(*by).orderBy("v")
    side = lambda move: F.struct(F.abs(move("v").over(order) - F.col("v")).alias("far"), move("lo").over(order).alias("id"))
    two = two.withColumns({"below": side(F.lag), "above": side(F.lead)})
    near = F.when(F.col("second").isNotNull(), F.when(F.col("id") == F.col("lo"), F.col("second")).otherwise(F.col("lo"))).otherwise(F.least(*(F.when(F.col(c)["id"].isNotNull(), F.col(c)) for c in ("below", "above")))["id"])
    return rows.join(two, [*by, "v"]).select("id", near.alias("other")).where("other is not null")


def only_candidate(pairs: DataFrame, left_id: str) -> DataFrame:
    """The pairs whose left row has no other candidate."""
    one = pairs.groupBy(left_id).agg(F.count("*").alias("_n")).where("_n = 1").select(left_id)
    return pairs.join(one, left_id, "left_semi")


def duplicate_pairs(df: DataFrame, id_col: str, reasons: dict[str, Column], least: int = 2, most: int = 6) -> DataFrame:
    """(a, b, reasons): pairs that share some key, for groups of ``least`` to ``most`` members; larger groups are no evidence. The reasons of a pair are sorted and comma-joined."""
    tagged = [df.select(F.col(id_col).alias("id"), F.lit(name).alias("reason"), key.cast("string").alias("key")) for name, key in reasons.items()]
    rows = tagged[0]
    for x in tagged[1:]:
        rows = rows.unionByName(x)
    rows = rows.where("key is not null and key <> ''").distinct()
    sizes = rows.groupBy("reason", "key").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).drop("n")
    rows = rows.join(sizes, ["reason", "key"])
    groups = rows.groupBy("reason", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = groups.select("reason", "ids", F.posexplode("ids").alias("i", "a")).select("reason", "a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def shared_word_pairs(df: DataFrame, id_col: str, words: Column, least: int = 2, most: int = 20, least_shared: int = 1, least_share: float = 0.0) -> DataFrame:
    """(a, b, shared): pairs that share words which ``least`` to ``most`` rows have.

    The bound on a word's rows is part of the rule: frequent words tell nothing. Pairs need
    ``least_shared`` such words and ``least_share`` of the smaller row's distinct words.
    """
    rows = df.select(F.col(id_col).alias("id"), F.array_distinct(words).alias("words"))
    sized = rows.select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    rare = sized.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("word")
    posts = sized.join(rare, "word").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("rows"))
    pairs = posts.select("rows", F.posexplode("rows").alias("i", "a")).select("a", F.explode(F.slice("rows", F.col("i") + 2, F.size("rows"))).alias("b"))
    counted = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("a.size", "b.size")).alias("least"))
    return counted.where((F.col("shared") >= least_shared) & (F.col("shared") >= least_share * F.col("least"))).select("a", "b", "shared")


def near_names(df: DataFrame, name: str, most_edits: int, block: Column) -> DataFrame:
    """(a, b, edits): distinct names of one block at most so many edits apart."""
    names = df.select(F.col(name).alias("a"), block.alias("_block")).where("a is not null").distinct()
    other = names.withColumnRenamed("a", "b")
    pairs = names.join(other, "_block").where("a < b").where(F.abs(F.length("a") - F.length("b")) <= most_edits)
    return pairs.withColumn("edits", F.levenshtein("a", "b", most_edits)).where("edits >= 0").select("a", "b", F.col("edits").cast("long").alias("edits")).distinct()


def similar_names(df: DataFrame, id_col: str, name: str, block: str | None = None, least_chars: int = 5, least_ratio: float = 0.9) -> DataFrame:
    """(a, b, ratio): rows whose names, of ``least_chars`` at least, differ and have a Ratcliff-Obershelp ratio of ``least_ratio`` (0.9 or more); only rows of one ``block`` where it is given.

    At a ratio of 0.9 the matching runs hold 0.45 of both lengths and are at most one more
    than the other characters, a tenth of both lengths: the names share at least that
    number of three-character grams less two a run. Grams are ordered by how many names
    have them, rare ones first, and names meet in their first grams, as many as leave too
    few for that number. Only pairs that also fit in length get their ratio.
    """
    rows = df.select(F.col(id_col).alias("id"), (F.col(block) if block else F.lit(0)).alias("block"), F.col(name).alias("name")).where(F.length("name") >= least_chars)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substr("name", i, F.lit(3))))
    size = F.length("name")
    # against a name at most 11/9 as long: runs and characters that match
    other = F.floor(size * 0.1 * (1 + 11 / 9))
    need = F.greatest(F.ceil(0.45 * size * (1 + 9 / 11)) - 2 * (other + 1), F.lit(1))
    kinds = rows.select("block", "name").distinct().select("block", "name", need.alias("need"), F.explode(grams).alias("gram"))
    ranked = kinds.join(kinds.groupBy("block", "gram").agg(F.count("*").alias("n")), ["block", "gram"])
    whole = W.partitionBy("block", "name")
    # a repeated gram counts once in the list but may match often: it lowers what is needed
    repeats = F.greatest(F.length("name") - 2 - F.count("*").over(whole), F.lit(0))
    ranked = ranked.withColumns({"place": F.row_number().over(whole.orderBy("n", "gram")), "all": F.count("*").over(whole), "need": F.greatest(F.col("need") - repeats, F.lit(1))})
    first = ranked.where("place <= all - need + 1").select("block", "gram", "name")
    pairs = first.join(first.withColumnRenamed("name", "name_b"), ["block", "gram"]).where("name < name_b")
    pairs = pairs.where(F.least(F.length("name"), F.length("name_b")) * 2 >= least_ratio * (F.length("name") + F.length("name_b"))).select("block", "name", "name_b").distinct()
    pairs = pairs.withColumn("ratio", similarity.exact_ratio("name", "name_b")).where(F.col("ratio") >= least_ratio)
    found = pairs.join(rows, ["block", "name"]).withColumnRenamed("id", "_a").join(rows.select("block", F.col("name").alias("name_b"), F.col("id").alias("_b")), ["block", "name_b"])
    return found.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "ratio")


def similar_titles(df: DataFrame, id_col: str, artist_key: str, title: str, seconds: str, least_ratio: float = 0.9, most_seconds: float = 5.0) -> DataFrame:
    """(a, b, ratio): songs of one artist, at most ``most_seconds`` apart in duration, whose base titles, of 4 characters at least, differ but are alike. At a ratio of 0.9, base titles of 4 characters are alike only when they are equal."""
    rows = df.select(F.col(id_col).alias("id"), F.col(artist_key).alias("artist"), keys.base_title(F.col(title)).alias("base"), F.col(seconds).alias("seconds")).where("artist <> ''")
    pairs = similar_names(rows, "id", "base", "artist", 5, least_ratio)
    lengths = rows.select("id", "seconds")
    pairs = pairs.join(lengths.withColumnsRenamed({"id": "a", "seconds": "_a"}), "a").join(lengths.withColumnsRenamed({"id": "b", "seconds": "_b"}), "b")
    return pairs.where(F.abs(F.col("_a") - F.col("_b")) <= most_seconds).select("a", "b", "ratio")


def title_level(df: DataFrame, a: str, b: str, out: str = "level") -> DataFrame:
    """How far two titles agree: 3 the same, 2 one is part of the other or nearly the same, 1 the same base title, 0 different, null in different scripts.

    The exact ratio, the only step outside the JVM, is asked for base titles, whole titles
    and version qualifiers that decide a row; the rest passes it nulls.
    """
    ca, cb = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))

    def side(c: Column, s: str) -> dict[str, Column]:
        normal = keys.spelled_numbers(c)
        return {
            f"_key{s}": keys.spelled_key(c),
            f"_halves{s}": F.transform(F.split(c, r"\s+=\s+", -1), lambda x: keys.spelled_key(x)),
            f"_foreign{s}": keys.non_latin_letters(c) >= 2,
            f"_numbers{s}": F.array_distinct(F.regexp_extract_all(normal, F.lit("([0-9]+)"), F.lit(1))),
            f"_versions{s}": keys.version_qualifiers(c),
            f"_parts{s}": keys.title_parts(c),
            f"_letters{s}": keys.letters(normal),
        }

    df = df.withColumns(side(ca, "a") | side(cb, "b"))
    df = df.withColumns({f"_base{s}": F.split(f"_key{s}", r"\|")[0] for s in "ab"})
    col = F.col
    halves = (F.size("_halvesa") > 1) | (F.size("_halvesb") > 1)
    bilingual = halves & (F.size(F.array_remove(F.array_intersect("_halvesa", "_halvesb"), F.lit(""))) > 0)
    numbers = (F.size(F.array_except("_numbersa", "_numbersb")) > 0) & (F.size(F.array_except("_numbersb", "_numbersa")) > 0)
    both = (F.size("_versionsa") > 0) & (F.size("_versionsb") > 0)
    open_ = ~bilingual & (col("_foreigna") == col("_foreignb")) & (col("_keya") != col("_keyb")) & ~numbers
    df = df.withColumn("_ratio", similarity.exact_ratio(*_asked(open_, "_letters"))).withColumn("_ratio_base", similarity.exact_ratio(*_asked(open_, "_base")))
    df = df.withColumn("_ratio_versions", _best_ratio(F.when(open_ & both, col("_versionsa")), F.when(open_ & both, col("_versionsb"))))
    top = F.when((F.size("_versionsa") > 0) != (F.size("_versionsb") > 0), 1).otherwise(2)
    last = F.try_element_at("_partsa", F.lit(-1)) == F.try_element_at("_partsb", F.lit(-1))
    part = F.array_contains("_partsb", col("_keya")) | F.array_contains("_partsa", col("_keyb")) | ((F.size("_partsa") > 1) & (F.size("_partsb") > 1) & last)
    level = (
        F.when(bilingual, 2)
        .when(col("_foreigna") != col("_foreignb"), None)
        .when(col("_keya") == col("_keyb"), 3)
        .when(numbers, 0)
        .when(both & ~(F.coalesce("_ratio_versions", F.lit(0.0)) >= 0.6), 0)
        .when(part, top)
        .when(F.coalesce("_ratio", F.lit(0.0)) >= 0.85, top)
        .when((col("_basea") != "") & (col("_basea") == col("_baseb")), 1)
        .when(F.coalesce("_ratio_base", F.lit(0.0)) >= 0.85, 1)
        .otherwise(0)
    )
    return df.withColumn(out, level).drop(*(c for c in df.columns if c.startswith("_")))


def _asked(when: Column, name: str) -> list[Column]:
    ask = when & (F.col(f"{name}a") != "") & (F.col(f"{name}b") != "")
    return [F.when(ask, F.col(f"{name}{s}")) for s in "ab"]


@F.pandas_udf(T.DoubleType())
def _best_ratio(a, b):
    import difflib

    import pandas as pd

    def best(x, y):
        return None if x is None or y is None else max(difflib.SequenceMatcher(None, p, q).ratio() for p in x for q in y)

    return pd.Series([best(x, y) for x, y in zip(a, b)], dtype="float64")


_best_ratio = _best_ratio.asNondeterministic()


def same_recording(df: DataFrame, level: str, duration: str, rec_duration: str, isrcs: str, rec_isrcs: str, known_print: str | None = None, out: str = "same") -> DataFrame:
    """``out``: whether a recording is the file's, and ``reason``; by identifiers and duration, title level and duration, or both where one is unknown."""
    n = F.col(level)
    isrc = F.coalesce(F.arrays_overlap(isrcs, rec_isrcs), F.lit(False))
    no_length = F.coalesce(F.col(rec_duration), F.lit(0)) == 0
    length = ~no_length & tolerance.same_recording_length(F.col(duration), F.col(rec_duration))
    heard = F.coalesce(F.col(known_print), F.lit(False)) if known_print else F.lit(False)
    result = (
        F.when(isrc & length, F.struct(F.lit(True).alias("same"), F.lit("isrc and duration").alias("reason")))
        .when(n.isNull(), F.struct((length & (isrc | heard)).alias("same"), F.lit("other script").alias("reason")))
        .when((n >= 1) & length, F.struct(F.lit(True).alias("same"), F.lit("title and duration").alias("reason")))
        .when((n >= 2) & no_length, F.struct(F.lit(True).alias("same"), F.lit("title, duration unknown").alias("reason")))
        .when((n >= 2) & isrc, F.struct(F.lit(True).alias("same"), F.lit("title and isrc").alias("reason")))
        .otherwise(F.struct(F.lit(False).alias("same"), F.lit("no match").alias("reason")))
    )
    return df.withColumn("_r", result).withColumns({out: F.col("_r.same"), "reason": F.col("_r.reason")}).drop("_r")


#: Pairs of a group that one task chooses from, in order; it keeps the used sides of one group at a time.
TASK_PAIRS = 200_000
#: Rounds over larger groups before they are divided into their connected parts.
FIRST_ROUNDS = 8


def greedy_pairs(pairs: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[str], task_pairs: int = TASK_PAIRS) -> DataFrame:
    """A one-to-one choice from candidate pairs: in the given order, each pair whose two sides are both still free.

    Groups of at most ``task_pairs`` pairs are gone through in order, each within one task.
    Larger ones go in rounds: a pair that comes first for both its sides is chosen
    whatever the others are, so all such pairs are taken and those of used sides left out;
    what has become small enough goes to a task. After :data:`FIRST_ROUNDS` of them the
    rest is divided into connected parts, which don't touch each other, and these count as
    groups. Only a connected part that stays larger needs more rounds. Pairs with a null in
    group or sides are left out.
    """
    columns = [*group, left, right, *(c for c in order if c not in (*group, left, right))]
    place = F.struct(*order, *(c for c in (left, right) if c not in order))
    now, chosen, parts = written(pairs.select(*columns).dropna(subset=[*group, left, right])), [], list(group)
    for n in itertools.count(1):
        large = _large(now, parts, task_pairs)
        if large.isEmpty():
            chosen.append(written(_in_order(now, parts, left, right, order).select(*columns)))
            forget(now, large)
            break
        small = now.join(large, parts, "left_anti") if parts else now.limit(0)
        chosen.append(written(_in_order(small, parts, left, right, order).select(*columns)))
        rest = written(now.join(large, parts, "left_semi") if parts else now)
        forget(now, large)
        first = {side: rest.groupBy(*parts, side).agg(F.min(place).alias(f"_{side}")) for side in (left, right)}
        best = rest.join(first[left], [*parts, left]).join(first[right], [*parts, right]).where((place == F.col(f"_{left}")) & (place == F.col(f"_{right}")))
        taken = written(best.select(*rest.columns).distinct())
        after = rest
        for side in (left, right):
            after = after.join(taken.select(*parts, side), [*parts, side], "left_anti")
        if n == FIRST_ROUNDS:
            after = _connected(written(after.select(*rest.columns)), group, left, right)
            parts = [*group, "_part"]
            now = written(after)
        else:
            now = written(after.select(*rest.columns))
        chosen.append(written(taken.select(*columns)))
        forget(rest, taken)
        if len(chosen) > FIRST_ROUNDS:
            together = written(functools.reduce(DataFrame.unionByName, chosen))
            forget(*chosen)
            chosen = [together]
    return functools.reduce(DataFrame.unionByName, chosen)


def _large(pairs: DataFrame, group: Sequence[str], task_pairs: int) -> DataFrame:
    """The groups of more pairs than that: few, as a rule none."""
    sizes = pairs.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > task_pairs)
    return written(sizes.select(*group) if group else sizes)


def _in_order(pairs: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """The choice within each group, whose pairs pass through one task in order."""
    at = [*group, *order, *(c for c in (left, right) if c not in order)]
    rows = (pairs.repartition(*group) if group else pairs.coalesce(1)).sortWithinPartitions(*at)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used = None, (set(), set())
        for batch in batches:
            keep = []
            keys_ = zip(*(batch[c].to_pylist() for c in group)) if group else itertools.repeat(())
            for key, a, b in zip(keys_, batch[left].to_pylist(), batch[right].to_pylist()):
                if key != here:
                    here, used = key, (set(), set())
                free = a not in used[0] and b not in used[1]
                if free:
                    used[0].add(a)
                    used[1].add(b)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(choose, rows.schema)


def _connected(pairs: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """The pairs with ``_part``, the smallest name of a side that they reach within their group."""
    name = lambda side: F.md5(F.to_json(F.struct(*group, F.lit(side).alias("_side"), F.col(left if side == "a" else right).alias("_id"))))
    named = pairs.withColumns({"_a": name("a"), "_b": name("b")})
    parts = connected_components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return named.join(parts.withColumnsRenamed({"id": "_a", "component": "_part"}), "_a").drop("_a", "_b")


def nearest_store(pairs: DataFrame, song: str, store_rank: str, difference: str, candidate: str) -> DataFrame:
    """For each song the candidate of the first store that has any, the nearest in duration."""
    return pairs.groupBy(song).agg(F.min_by(candidate, F.struct(F.col(store_rank), F.col(difference), F.col(candidate))).alias(candidate))


def nearest_by(base: DataFrame, asked: DataFrame, on: Sequence[str], value: str, id_col: str, near: float) -> DataFrame:
    """(on, value, _near, _away): for the keys and values of ``asked`` the id of the ``base`` row with the same keys whose value is nearest and at most ``near`` away, ties by id.

    Equal values count once. Values are cut into bands; each band has its own values and
    the last one of either neighbour, and one sweep up and one down give every value asked
    for its neighbours, so no pairs are made.
    """
    width = 2.0 * near if near > 0 else 1.0
    band = F.floor(F.col(value).cast("double") / width)
    finite = F.abs(F.col(value).cast("double")) < float("inf")
    base, asked = base.dropna(subset=[*on]), asked.dropna(subset=[*on])
    known = base.where(finite).groupBy(*on, value).agg(F.min(id_col).alias("_id")).select(*on, band.alias("_band"), F.struct(F.col(value).alias("value"), F.col("_id").alias("id")).alias("_known"))
    ends = known.groupBy(*on, "_band").agg(F.min("_known").alias("_low"), F.max("_known").alias("_high"))
    edges = ends.select(*on, F.explode(F.array(F.struct((F.col("_band") - 1).alias("_band"), F.col("_low").alias("_known")), F.struct((F.col("_band") + 1).alias("_band"), F.col("_high").alias("_known")))).alias("_edge")).select(*on, "_edge.*")
    wanted = asked.where(finite).select(*on, value).distinct().withColumn("_band", band)
    rows = known.unionByName(edges).withColumn(value, F.col("_known.value")).unionByName(wanted, allowMissingColumns=True)
    here, asks = W.partitionBy(*on, "_band"), F.col("_known").isNull()
    last = lambda order: F.last("_known", ignorenulls=True).over(here.orderBy(order, asks).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_below", last(F.asc(value))).withColumn("_above", last(F.desc(value))).where(asks)
    away = lambda side: F.struct(F.abs(F.col(value) - F.col(f"{side}.value")).alias("away"), F.col(f"{side}.id").alias("id"))
    best = F.array_min(F.filter(F.array(away("_below"), away("_above")), lambda x: x["away"] <= near))
    return rows.select(*on, value, best["id"].alias("_near"), best["away"].alias("_away")).where("_away is not null")


def names_containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, name): the names that hold each needle as a substring.

    Names are indexed by their runs of three characters, needles meet them in the one of
    theirs that fewest names have; shorter needles by runs of their own length, for which
    names are cut only where some needle asks. Empty needles are in none.
    """
    needles = needles.select(F.col(needles.columns[0]).alias("needle")).where("needle <> ''").distinct()
    names = names.select(F.col(names.columns[0]).alias("name")).where("name <> ''").distinct()
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))
    whole = names.where(F.length("name") >= 3).select("name", F.explode(runs(F.col("name"), 3)).alias("gram"))
    rare = needles.where(F.length("needle") >= 3).select("needle", F.explode(runs(F.col("needle"), 3)).alias("gram")).join(whole.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    asked = rare.groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    found = asked.join(whole, "gram").where(F.contains("name", F.col("needle"))).select("needle", "name")
    for n in (1, 2):
        short = needles.where(F.length("needle") == n).select("needle", F.col("needle").alias("gram"))
        found = found.unionByName(short.join(names.where(F.length("name") >= n).select("name", F.explode(runs(F.col("name"), n)).alias("gram")), "gram").select("needle", "name"))
    return found


def shop_matches(songs: DataFrame, offers: DataFrame, looser: Sequence[int] = ()) -> DataFrame:
    """(song, offer, store, state, seconds_off) of every song: which shop's offer it is.

    ``songs`` has song, artist, title and seconds (null or 0: unknown), ``offers`` offer, store
    (its rank), artists (an array), title and seconds (null counts as 0). An artist is
    shared when the keys are equal or the key of the song's first artist stands in one of
    the offer's. The first shop counts in which an offer has the song's title key and a
    duration at most 3 s or 1 % away, the nearest of its offers, ties by offer: state ok.
    Without a duration the first shop with the title counts: state review. Else, in the
    ``looser`` shops before any such one, an offer whose title begins with the song's base
    title, at most 1 s away: state review title. Else none. Songs that ask for the same
    are looked up once, among the first of offers that are alike.
    """
    first = keys.artist_key(F.split(F.coalesce("artist", F.lit("")), r",\s*")[0])
    base = keys.store_base_title(F.col("title"))
    asked = songs.select("song", keys.store_artists(F.col("artist")).alias("_all"), first.alias("_first"), keys.title_key(F.col("title")).alias("_title"), base.alias("_base"), F.nullif(F.col("seconds").cast("double"), F.lit(0.0)).alias("_seconds"))
    what = ["_all", "_first", "_title", "_base", "_seconds"]
    asked = written(asked.withColumn("_ask", F.md5(F.to_json(F.struct(*what)))))
    asks = asked.groupBy("_ask").agg(*(F.first(c).alias(c) for c in what))
    shops = offers.select("offer", "store", F.array_distinct(F.transform("artists", lambda a: keys.artist_key(a))).alias("_names"), keys.title_key(F.col("title")).alias("_title"), keys.letters(F.lower("title")).alias("_whole"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    # of offers that are equal in all that counts only the first can be taken
    shops = written(shops.select("*", F.explode("_names").alias("_name")).groupBy("_name", "_title", "_whole", "store", "seconds").agg(F.min("offer").alias("offer")))
    by_key = asks.select("_ask", F.explode("_all").alias("_name"))
    inside = names_containing(asks.select("_first"), shops.select("_name")).select(F.col("needle").alias("_first"), F.col("name").alias("_name"))
    artists = by_key.unionByName(asks.select("_ask", "_first").join(inside, "_first").select("_ask", "_name")).distinct()
    known = asks.join(artists, "_ask").drop("_all", "_first")
    off = F.abs(F.col("seconds") - F.col("_seconds"))
    same = shops.groupBy("_name", "_title", "store", "seconds").agg(F.min("offer").alias("offer"))
    unsure = same.groupBy("_name", "_title").agg(F.min(F.struct("store", "offer")).alias("least"))
    review = known.where("_seconds is null").join(unsure, ["_name", "_title"]).groupBy("_ask").agg(F.min(F.struct(F.lit(0).alias("late"), "least.store", F.lit(0.0).alias("off"), "least.offer")).alias("best")).withColumn("state", F.lit("review"))
    banded = known.where("_seconds is not null").withColumn("_band", F.explode(F.sequence(tolerance.band(F.col("_seconds")) - 1, tolerance.band(F.col("_seconds")) + 1)))
    fits = banded.join(same.withColumn("_band", tolerance.band(F.col("seconds"))), ["_name", "_title", "_band"]).where(~tolerance.other_version(F.col("seconds"), F.col("_seconds")))
    ok = fits.groupBy("_ask").agg(F.min(F.struct(F.lit(0).alias("late"), "store", off.alias("off"), "offer")).alias("best")).withColumn("state", F.lit("ok"))
    # seconds at most 1 apart fall into the same whole second or the next
    begun = shops.where(F.col("store").isin(*looser)).groupBy("_name", "_whole", "store", "seconds").agg(F.min("offer").alias("offer")).withColumn("_second", F.floor("seconds"))
    near = known.where("_seconds is not null and _base <> ''").withColumn("_second", F.explode(F.sequence(F.floor(F.col("_seconds")) - 1, F.floor(F.col("_seconds")) + 1)))
    loose = near.join(begun, ["_name", "_second"]).where(F.col("_whole").startswith(F.col("_base")) & (off <= 1))
    later = loose.groupBy("_ask").agg(F.min(F.struct(F.lit(1).alias("late"), "store", off.alias("off"), "offer")).alias("best")).withColumn("state", F.lit("review title"))
    best = ok.unionByName(review).unionByName(later).groupBy("_ask").agg(F.min_by(F.struct("best", "state"), "best").alias("b"))
    return asked.select("song", "_ask").join(best, "_ask", "left").select("song", F.col("b.best.offer").alias("offer"), F.col("b.best.store").alias("store"), F.coalesce("b.state", F.lit("none")).alias("state"), F.col("b.best.off").alias("seconds_off"))


def look_alikes(df: DataFrame, id_col: str, words: str, most_bits: int = 20, bits: int = 256, width: int = 32) -> tuple[DataFrame, DataFrame]:
    """((id, look), (a, b, bits)): the look of every row, and the pairs of looks at most ``most_bits`` bits apart.

    ``words`` is an array of ``width``-bit words, ``bits`` in all. Rows with equal words
    have one look, numbered by their smallest id, so copies aren't paired. The bits are cut
    into ``most_bits`` + k parts, of which looks so near have k in common: they meet by
    every choice of k parts, and a pair counts where these are the first k that it shares.
    The more looks there are, the larger is k (:func:`_shared_parts`), so that chance
    meetings don't grow with the square. Rows without words have no look.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(words).alias("w")).where("size(w) > 0")
    looks = written(rows.groupBy("w").agg(F.min("id").alias("look")))
    common = _shared_parts(looks.count(), most_bits, bits)
    n, count = most_bits + common, -(-bits // width)
    cuts = [bits * i // n for i in range(n + 1)]

    def part(values: Sequence[Column], a: int, b: int) -> Column:
        value = F.lit(0).cast("long")
        for word in range(a // width, (b - 1) // width + 1):
            low, high = max(a, word * width), min(b, (word + 1) * width)
            taken = F.shiftrightunsigned(values[word], low - word * width).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
            value = value.bitwiseOR(F.shiftleft(taken, low - a))
        return value

    left, right = [f"a{i}" for i in range(count)], [f"b{i}" for i in range(count)]
    flat = looks.select("look", *(F.get("w", F.lit(i)).cast("long").alias(c) for i, c in enumerate(left)))
    cut = flat.select("*", F.array(*(part([F.col(c) for c in left], a, b) for a, b in zip(cuts, cuts[1:]))).alias("parts"))
    choices = list(itertools.combinations(range(n), common))
    keyed = F.array(*(F.struct(F.lit(",".join(map(str, c))).alias("at"), F.xxhash64(F.lit(i), *(F.col("parts")[j] for j in c)).alias("key")) for i, c in enumerate(choices)))
    each = cut.select("look", *left, F.explode(keyed).alias("k")).select("look", *left, "k.at", "k.key")
    other = each.select(F.col("look").alias("b"), *(F.col(c).alias(d) for c, d in zip(left, right)), "key")
    off = [F.col(c).bitwiseXOR(F.col(d)) for c, d in zip(left, right)]
    apart = functools.reduce(Column.__add__, map(F.bit_count, off))
    pairs = each.withColumnRenamed("look", "a").join(other, "key").where((F.col("a") < F.col("b")) & (apart <= most_bits))
    shared = F.array_compact(F.array(*(F.when(part(off, a, b) == 0, F.lit(str(j))) for j, (a, b) in enumerate(zip(cuts, cuts[1:])))))
    found = pairs.where(F.array_join(F.slice(shared, 1, common), ",") == F.col("at")).select("a", "b", apart.cast("long").alias("bits"))
    return rows.join(looks, "w").select("id", "look"), found


def _shared_parts(looks: int, most_bits: int, bits: int, row_cost: int = 30) -> int:
    """How many parts looks should meet by: the number with the least work, a row of a table counting as ``row_cost`` pairs."""

    def work(k: int) -> float:
        keys = math.comb(most_bits + k, k)
        return keys * looks * (row_cost + looks / 2 ** (1 + bits * k / (most_bits + k)))

    return min((k for k in range(1, 6) if k == 1 or (most_bits + k <= bits and math.comb(most_bits + k, k) <= 2000)), key=work)


#: What speaks for a candidate, from the first: its record is at hand, its ISRC fits, its print is known, how far titles agree, how far durations differ.
EVIDENCE = ("record", "isrc", "print", "level", "seconds_off")


def ranked_candidates(sources: Sequence[tuple[str, DataFrame]], key: Sequence[str], candidate: str, evidence: DataFrame | None = None) -> DataFrame:
    """Candidates of several sources in one table, with ``sources`` sorted and ``place`` from 1.

    ``evidence`` (key, candidate and the columns of :data:`EVIDENCE`, unique) ranks them:
    record, ISRC and print first, then the higher level (null: 0) and the smaller
    difference in duration (null: 0). Then more sources come first, then the candidate.
    """
    rows = None
    for name, df in sources:
        part = df.select(*key, candidate).distinct().withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy(*key, candidate).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    order: list[Column] = []
    if evidence is not None:
        merged = merged.join(evidence.select(*key, candidate, *EVIDENCE), [*key, candidate], "left")
        order = [F.coalesce(c, F.lit(False)).desc() for c in EVIDENCE[:3]] + [F.coalesce("level", F.lit(0)).desc(), F.coalesce("seconds_off", F.lit(0)).asc()]
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order, F.desc(F.size("sources")), candidate))
    return merged.withColumn("place", place).select(*key, candidate, "sources", "place")


def first_resolved(candidates: DataFrame, known: DataFrame, on: Sequence[str], by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` candidates of each group, in ``order``, that ``known`` has; ``place`` numbers them from 1. A null key is never known."""
    found = candidates.join(known.select(*on).distinct(), [*on], "left_semi").select(*candidates.columns)
    return found.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of one table that the other lacks, with the side that has them."""
    left = a.select(*on).distinct().withColumn("_a", F.lit(True))
    right = b.select(*on).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, [*on], "full_outer").where("_a is null or _b is null")
    return both.select(*on, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))
