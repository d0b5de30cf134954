"""Releases: which edition a folder is, how editions merge, what a collected album holds, whose an id is.

Groups are compared through aggregates, and numbered by ranges, so that none has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sieveworks.functions import tolerance
from sieveworks.operators import consensus, match
from sieveworks.operators.numbering import numbered
from sieveworks.sources.storage import forget, settled, written


def choose_edition(songs: DataFrame, editions: DataFrame, folder: str, song: str, edition: str, place: str, order: Sequence[str] = ()) -> DataFrame:
    """(folder, edition, fits, ambiguous) for every folder all of whose songs stand in some edition.

    Of the editions that fit, the first by ``order`` and by name is taken; ``fits`` counts
    them, and ambiguous says that they put the songs in different places. A song that an
    edition repeats has its first place. Folders of the same songs are looked up once. An
    edition that fits holds the folder's rarest song: the editions of that song are
    looked up for the next rarest one, and only those that have both for the rest.
    """
    songs = songs.select(folder, song).where(F.col(folder).isNotNull() & F.col(song).isNotNull()).distinct()
    tracks = written(editions.where(F.col(song).isNotNull()).groupBy(F.col(edition).alias("_edition"), song).agg(F.min(place).alias("_place"), *(F.min(c).alias(c) for c in order)))
    sets = songs.groupBy(folder).agg(F.md5(F.to_json(F.array_sort(F.collect_list(song)))).alias("_set"))
    named = written(sets.join(sets.groupBy("_set").agg(F.min(folder).alias("_first")), "_set").select(folder, "_first"))
    asked = songs.join(named.where(F.col(folder) == F.col("_first")).select(folder), folder, "left_semi").withColumnRenamed(folder, "_first")
    known = asked.join(tracks.groupBy(song).agg(F.count("*").alias("_in")), song, "left")
    rare = W.partitionBy("_first").orderBy(F.coalesce("_in", F.lit(0)), song)
    ranked = written(known.select("_first", song, F.row_number().over(rare).alias("_at"), F.lead(song).over(rare).alias("_next"), F.count("*").over(W.partitionBy("_first")).cast("int").alias("_size")))
    held = tracks.select(F.col("_edition").alias("_held"), song)
    both = F.col("_edition").eqNullSafe(F.col("_held"))

    one = ranked.where("_at = 1").join(tracks.select("_edition", song), song).select("_first", "_size", "_edition", "_next")
    two = written(one.where("_size > 1").join(held.withColumnRenamed(song, "_next_held"), both & (F.col("_next") == F.col("_next_held")), "left_semi").select("_first", "_size", "_edition"))
    rest = two.where("_size > 2").join(ranked.where("_at > 2").select("_first", F.col(song).alias("_song")), "_first")
    rest = rest.join(held, both & (F.col("_song") == F.col(song))).groupBy("_first", "_size", "_edition").agg(F.count("*").alias("_n")).where("_n = _size - 2")
    fits = one.where("_size = 1").select("_first", "_edition").unionByName(two.where("_size = 2").select("_first", "_edition")).unionByName(rest.select("_first", "_edition"))

    placed = fits.join(ranked.select("_first", F.col(song).alias("_song")), "_first").withColumnRenamed("_edition", "_held").join(tracks, both & (F.col("_song") == F.col(song)))
    placed = placed.groupBy("_first", "_edition").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct(song, "_place"))))).alias("_places"), *(F.min(c).alias(c) for c in order))
    best = F.min_by("_edition", F.struct(*order, "_edition")).alias(edition)
    chosen = placed.groupBy("_first").agg(best, F.count("*").alias("fits"), (F.count_distinct("_places") > 1).alias("ambiguous"))
    return named.join(chosen, "_first").select(folder, edition, "fits", "ambiguous")


def edition_candidates(songs: DataFrame, editions: DataFrame, tracks: DataFrame, folder: str, edition: str) -> DataFrame:
    """(folder, edition): the editions of the folder's album name that hold one of its ISRCs, or are by its artist.

    ``songs`` and ``editions`` have album_key and artist_key, ``songs`` isrcs too and
    ``tracks`` isrc. A folder's album and artist are those of most of its songs. Both ways
    are joins by the album and one more key.
    """
    usual = consensus.majority(songs, [folder], "album_key").select(folder, F.col("winner").alias("album_key")).join(consensus.majority(songs, [folder], "artist_key").select(folder, F.col("winner").alias("artist_key")), folder)
    held = tracks.where("isrc <> ''").select(edition, "isrc").distinct().join(editions.select(edition, "album_key"), edition)
    by_isrc = songs.select(folder, F.explode("isrcs").alias("isrc")).distinct().join(usual.select(folder, "album_key"), folder).join(held, ["album_key", "isrc"]).select(folder, edition)
    by_name = usual.join(editions.select(edition, "album_key", "artist_key"), ["album_key", "artist_key"]).select(folder, edition)
    return by_isrc.unionByName(by_name).distinct()


def matched_tracks(songs: DataFrame, tracks: DataFrame, candidates: DataFrame, folder: str, edition: str) -> DataFrame:
    """(folder, edition, song, track, by): which track of a candidate edition each song of a folder is, one to one.

    ``songs`` has song (its order), isrcs, title_key and seconds, ``tracks`` track (its
    order), isrc, title_key and seconds. First by ISRC, where durations are at most 7 s or
    3 % of the track's apart, then the songs and tracks that are left by title, at most 3 s
    or 1 %. In each pass songs in their order take the first free track. Tracks without a
    duration are no song's.
    """
    near = lambda least, share: ~tolerance.far_from(F.col("_seconds"), F.col("seconds"), least, share)
    key = lambda n, c: F.struct(F.lit(n).cast("byte").alias("_pass"), c.cast("string").alias("_key"))
    asked = F.concat(F.transform(F.coalesce("isrcs", F.array().cast("array<string>")), lambda x: key(1, x)), F.array(key(2, F.col("title_key"))))
    named = "_key is not null and (_pass = 2 or _key <> '')"
    rows = candidates.join(songs.select(folder, "song", asked.alias("_keys"), F.col("seconds").alias("_seconds")), folder).select(folder, edition, "song", "_seconds", F.explode("_keys").alias("_k"))
    rows = rows.select(folder, edition, "song", "_seconds", "_k.*").where(named)
    whole = tracks.where("seconds > 0").select(edition, "track", "seconds", F.explode(F.array(key(1, F.col("isrc")), key(2, F.col("title_key")))).alias("_k")).select(edition, "track", "seconds", "_k.*").where(named)
    # in this order the second pass meets only what the first left free; a pair that repeats is free once
    pairs = rows.join(whole, [edition, "_pass", "_key"]).where(F.when(F.col("_pass") == 1, near(7, 0.03)).otherwise(near(3, 0.01))).select(folder, edition, "_pass", "song", "track")
    chosen = match.greedy_pairs(pairs, [folder, edition], "song", "track", ["_pass", "song", "track"])
    return chosen.select(folder, edition, "song", "track", F.when(F.col("_pass") == 1, "isrc").otherwise("title").alias("by"))


#: Bytes of the folders that meet an edition's tracks at once.
TASK_BYTES = 64 << 20


def number_by_edition(songs: DataFrame, editions: DataFrame, tracks: DataFrame, candidates: DataFrame, folder: str = "folder", edition: str = "edition", task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(folder, edition, fits, state) of every folder, and (folder, song, disc, pos) of those whose state is numbered.

    An edition fits if it is whole (``nb_tracks``, null: unknown) and every song of the
    folder is one of its tracks (as in :func:`matched_tracks`). Where the editions that fit
    put songs in different places, or differ in being on several discs, the state is
    ambiguous; without one it is none. Else the edition with the most songs by ISRC is
    taken, then one of the folder's date, of its year, the shortest, the smallest name.
    ``tracks`` has disc and pos, ``editions`` date, ``songs`` date, of which the most
    frequent counts. A folder's songs are one row. A task keeps one edition's tracks at a
    time and the folders that ask for it; where these are more than ``task_bytes``, they
    meet the tracks in parts.
    """
    isrcs = F.transform(F.filter("isrcs", lambda x: x != ""), _field)
    row = F.struct("song", _seconds("seconds").alias("seconds"), F.concat(F.array(_field(F.col("title_key"))), F.coalesce(isrcs, F.array().cast("array<string>"))).alias("keys"))
    held = songs.groupBy(folder).agg(F.mode(F.coalesce("date", F.lit("")), True).alias("_date"), F.sort_array(F.collect_list(F.when(F.col("song").isNotNull(), row))).alias("_rows"))
    wanted = candidates.dropna(subset=[folder, edition]).groupBy(folder).agg(F.collect_set(edition).alias("_editions"))
    # a row more of one song is marked by a sign
    again = lambda x, i: (i > 0) & (F.get("_rows", i - 1)["song"] == x["song"])
    line = lambda x, i: F.concat(F.when(again(x, i), "+").otherwise(""), F.array_join(F.concat(F.array(x["seconds"]), x["keys"]), "\t"))
    text = F.array_join(F.transform("_rows", line), "\n").cast("binary")
    folders = settled(held.join(wanted, folder, "left").select(folder, "_date", F.array_distinct(F.transform("_rows", lambda x: x["song"])).alias("_songs"), text.alias("_text"), "_editions"))

    in_order = W.partitionBy(edition).orderBy("track")
    about = editions.groupBy(edition).agg(F.collect_list(F.struct("date", F.col("nb_tracks").cast("double").alias("least"))).alias("_about"))
    keys = F.concat_ws("\t", _seconds("seconds"), _field(F.col("title_key")), F.coalesce(_field(F.nullif("isrc", F.lit(""))), F.lit(NONE))).cast("binary")
    listed = tracks.withColumns({"_rank": F.dense_rank().over(in_order), "_at": F.row_number().over(in_order)}).join(about, edition)
    listed = listed.select(edition, F.when(F.col("track").isNotNull(), F.col("_rank")).alias("_rank"), "disc", "pos", keys.alias("_keys"), F.when(F.col("_at") == 1, F.col("_about")).alias("_about"))
    asked = folders.where("size(_songs) > 0").select(F.explode("_editions").alias(edition), F.col(folder).alias("_folder"), "_text")
    by = [edition]
    many = settled(asked.groupBy(edition).agg(F.sum(F.octet_length("_text") + 32).alias("_bytes")).where(F.col("_bytes") > task_bytes).select(edition, F.ceil(F.col("_bytes") / task_bytes).alias("_parts")))
    if not many.isEmpty():
        by = [edition, "_part"]
        parts = F.coalesce("_parts", F.lit(1).cast("long"))
        asked = asked.join(many, edition, "left").withColumn("_part", F.pmod(F.xxhash64("_folder"), parts)).drop("_parts")
        listed = listed.join(many, edition, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    fits = settled(_fitting(listed, asked, edition, by))
    forget(many)

    date = F.coalesce("date", F.lit(""))
    order = F.struct(-F.col("_by_isrc"), date != F.col("_date"), F.left(date, F.lit(4)) != F.left("_date", F.lit(4)), F.col("_tracks"), F.col(edition))
    places = ["_at", "_disc", "_pos"]
    signs = F.struct(*places, F.col("_discs") > 1)
    facts = [F.count("_by_isrc").alias("fits"), F.min_by(F.struct(edition, *places), order).alias("_best"), F.min(F.when(F.col("_by_isrc").isNotNull(), signs)).alias("_least"), F.max(F.when(F.col("_by_isrc").isNotNull(), signs)).alias("_most")]
    best = folders.select(folder, "_date").join(fits.withColumnRenamed("_folder", folder), folder, "left").groupBy(folder).agg(*facts)
    state = F.when(F.col("fits") == 0, "none").when(F.col("_least").eqNullSafe(F.col("_most")), "numbered").otherwise("ambiguous")
    chosen = settled(best.withColumn("state", state).select(folder, F.when(F.col("state") == "numbered", F.col("_best")).alias("_best"), "fits", "state"))
    forget(fits)
    choice = chosen.select(folder, F.col(f"_best.{edition}").alias(edition), "fits", "state")
    numbers = chosen.where("state = 'numbered'").select(folder, F.arrays_zip(*(F.col(f"_best.{c}").alias(c) for c in places)).alias("_places")).join(folders.select(folder, "_songs"), folder)
    return choice, numbers.select(folder, "_songs", F.explode("_places").alias("_place")).select(folder, F.get("_songs", F.col("_place._at")).alias("song"), F.col("_place._disc").alias("disc"), F.col("_place._pos").alias("pos"))


#: What stands for a null in a line; no text has it, since a backslash in one is doubled.
NONE = "\\0"


def _seconds(name: str) -> Column:
    """A duration in as few characters as give it again."""
    return F.coalesce(F.regexp_replace(F.col(name).cast("double").cast("string"), r"\.0$", ""), F.lit(NONE))


def _field(text: Column) -> Column:
    """The text without the tabs and line ends that divide fields and lines."""
    text = text.cast("string")
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit(NONE))


def _fitting(listed: DataFrame, asked: DataFrame, edition: str, by: Sequence[str]) -> DataFrame:
    """(folder, edition, by_isrc, tracks, discs, date, places) of the candidates that fit: an edition's ranked tracks meet the folders that ask for it."""
    types = {f.name: f.dataType.simpleString() for f in (*listed.schema, *asked.schema)}
    kind = f"_folder {types['_folder']}, {edition} {types[edition]}, _by_isrc int, _tracks int, _discs {types['disc']}, date string, _at array<int>, _disc array<{types['disc']}>, _pos array<{types['pos']}>"
    out = asked.sparkSession.createDataFrame([], kind).schema
    schema, none = to_arrow_schema(out), NONE.encode()

    def all_songs(text: bytes, by_isrc: dict, by_title: dict) -> tuple[int, list[int]] | None:
        """How many songs were matched by ISRC, and each song's track, if all have one. In each pass songs in order take the first free track within tolerance."""
        songs: list[list[tuple]] = []
        for line in text.split(b"\n"):
            more = line.startswith(b"+")
            seconds, title, *isrcs = line[more:].split(b"\t")
            form = (None if seconds == none else float(seconds), title, isrcs)
            if more:
                songs[-1].append(form)
            else:
                songs.append([form])
        used: set[int] = set()

        def first(asked: Iterable[tuple]) -> int | None:
            best = None
            for seconds, tracks in asked:
                for track, length, apart in tracks:
                    if best is not None and track >= best:
                        break
                    if track not in used and (abs(seconds - length) <= apart or length != length):
                        best = track
                        break
            if best is not None:
                used.add(best)
            return best

        choice = [first((s, by_isrc[x]) for s, _, isrcs in song if s is not None for x in isrcs if x in by_isrc) for song in songs]
        count = len(used)
        for k, song in enumerate(songs):
            if choice[k] is None:
                choice[k] = first((s, by_title[title]) for s, title, _ in song if s is not None and title in by_title)
                if choice[k] is None:
                    return None
        return count, choice

    def fit(listed: pa.Table, asked: pa.Table) -> pa.Table:
        n, by_isrc, by_title, places = len(listed), {}, {}, {}
        discs = max((x for x in listed["disc"].to_pylist() if x is not None), default=None)
        whole = [x for rows in listed["_about"].to_pylist() for x in rows or () if x["least"] is None or n >= x["least"]]
        if not whole or not len(asked):
            return schema.empty_table()
        for rank, disc, pos, text in sorted(zip(*(listed[c].to_pylist() for c in ("_rank", "disc", "pos", "_keys"))), key=lambda x: (x[0] or 0, repr(x[1:3]))):
            if rank is None:
                continue
            places.setdefault(rank, []).append((disc, pos))
            seconds, title, isrc = text.split(b"\t")
            if seconds != none and not (seconds := float(seconds)) <= 0:
                if isrc != none:
                    by_isrc.setdefault(isrc, []).append((rank, seconds, max(7.0, 0.03 * seconds)))
                if title != none:
                    by_title.setdefault(title, []).append((rank, seconds, max(3.0, 0.01 * seconds)))
        found: list[tuple] = []
        start = 0
        for batch in asked.to_batches():
            for i, text in enumerate(batch["_text"].to_pylist(), start):
                if (took := all_songs(text, by_isrc, by_title)) is not None:
                    spots = [(k, *spot) for k, x in enumerate(took[1]) for spot in places[x]]
                    found += [(i, took[0], n, discs, x["date"], *([s[k] for s in spots] for k in range(3))) for x in whole]
            start += len(batch)
        here = asked.take(pa.array([x[0] for x in found], pa.int64()))
        return pa.Table.from_arrays([here["_folder"], here[edition], *(pa.array([x[k - 1] for x in found], schema.field(k).type) for k in range(2, 9))], schema=schema)

    return listed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(fit, out)


def merge_editions(base: DataFrame, other: DataFrame, on: Sequence[str], album: str, id_col: str, length: str, near: float = 3.0, first_number: int = 900, number: str | None = None) -> DataFrame:
    """What becomes of every row of ``other`` when its album joins that of ``base``: (album, id, copy_of, number).

    copy_of is the id of the base row with the same key whose length is nearest and at most
    ``near`` away. A row without one is new to the album and gets the next number above
    ``first_number``, in the order of its key and id.
    """
    nearest = match.nearest_by(base, other, [album, *on], length, id_col, near)
    copies = other.join(nearest, [album, *on, length]).groupBy(album, id_col).agg(F.min_by("_near", F.struct("_away", "_near")).alias("copy_of"))
    rows = other.select(album, *on, id_col).join(copies, [album, id_col], "left")
    new = numbered(rows.where("copy_of is null").select(album, *on, id_col, "copy_of"), [album], [*on, id_col], "_place")
    old = rows.where("copy_of is not null").select(album, id_col, "copy_of", F.lit(None).cast("long").alias("number"))
    if number is None:
        return new.select(album, id_col, "copy_of", (first_number + F.col("_place")).alias("number")).unionByName(old)
    taken = base.groupBy(album).agg(F.max(F.when(F.col(number) > first_number, F.col(number))).alias("_last"))
    return new.join(taken, album, "left").select(album, id_col, "copy_of", (F.coalesce("_last", F.lit(first_number)) + F.col("_place")).alias("number")).unionByName(old)


def merged_dates(base: DataFrame, other: DataFrame, album: str, date: str) -> DataFrame:
    """(album, date, year): the earliest date of an album and of what joins it, and its year; null without any."""
    both = base.select(album, date).unionByName(other.select(album, date))
    return both.groupBy(album).agg(F.min(F.nullif(F.col(date), F.lit(""))).alias("date")).withColumn("year", F.left("date", F.lit(4)))


def collected_album(tracks: DataFrame, works: DataFrame, folder: str, work: str, order: Sequence[str | Column], date: str, least: int = 3) -> DataFrame:
    """The tracks of all folders of a work as one album: the columns of ``tracks``, work, number from 1 on by ``order``, and album_date, the earliest; works of fewer than ``least`` tracks are left out."""
    rows = tracks.join(works.select(folder, work).distinct(), folder)
    facts = rows.groupBy(work).agg(F.count("*").alias("_n"), F.min(date).alias("album_date")).where(F.col("_n") >= least).drop("_n")
    return numbered(rows.join(facts, work), [work], order, "number")


def with_suffixes(df: DataFrame, name: str, order: Sequence[str], out: str = "unique_name") -> DataFrame:
    """``out``: the name, with (2), (3) and so on behind its repeats, in ``order``."""
    return numbered(df, [name], order, "_place").withColumn(out, F.when(F.col("_place") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_place").cast("string"), F.lit(")")))).drop("_place")


def shared_ids(df: DataFrame, shared: str, id_col: str, score: str, evidence: str, least: float = tolerance.OTHER_AUDIO) -> DataFrame:
    """(shared, id, keeper, demoted) for all rows whose ``shared`` id several rows have: the one with the best score keeps it, and others lose it where the evidence is below ``least``; without evidence they keep it."""
    best = df.where(F.col(shared).isNotNull()).groupBy(shared).agg(F.count("*").alias("_n"), F.min_by(id_col, F.struct(-F.col(score), F.col(id_col))).alias("keeper")).where("_n > 1")
    rows = df.join(best, shared)
    return rows.select(shared, id_col, "keeper", ((F.col(id_col) != F.col("keeper")) & F.coalesce(F.col(evidence) < least, F.lit(False))).alias("demoted"))


def choose_list(lists: DataFrame, ids: DataFrame, list_col: str, id_col: str, least_share: float = 0.8) -> DataFrame:
    """(list, shared) of the list with as many distinct ids as ``ids`` that has the most of them, at least ``least_share``; ties go to the smaller name; none gives an empty result."""
    wanted = ids.select(id_col).distinct()
    size = wanted.agg(F.count("*")).scalar()
    rows = lists.select(list_col, id_col).distinct().join(wanted.withColumn("_hit", F.lit(True)), id_col, "left")
    found = rows.groupBy(list_col).agg(F.count("*").alias("_size"), F.count("_hit").alias("shared"))
    return found.where((F.col("_size") == size) & (F.col("shared") >= least_share * size)).orderBy(F.desc("shared"), list_col).limit(1).select(list_col, "shared")


def agreed_names(df: DataFrame, group: Sequence[str], id_col: str, name: str, official: DataFrame | None = None) -> DataFrame:
    """(group, id, old, new) of the rows that differ from their group's name, where a group has several: the official one (group, official) if there is one, else the most frequent."""
    facts = consensus.majority(df, group, name).drop("all_votes")
    several = df.groupBy(*group).agg(F.min(name).alias("_a"), F.max(name).alias("_b")).where("_a <> _b").select(*group)
    facts = facts.join(several, [*group], "left_semi")
    if official is not None:
        facts = facts.join(official.select(*group, "official"), [*group], "left").withColumn("winner", F.coalesce("official", "winner"))
    rows = df.join(facts.select(*group, "winner"), [*group])
    return rows.where(~F.col(name).eqNullSafe(F.col("winner"))).select(*group, id_col, F.col(name).alias("old"), F.col("winner").alias("new"))


def sibling_artists(tracks: DataFrame, official: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(release_group, album_key, path, old, new): the album artists to unify.

    ``tracks`` has path, folder, release_group, release, album_key and album_artist. The
    tracks of a release group with one album key belong together, and with them the
    tracks without a release group that have the album key in one of their folders. Where
    the former name several artists, the new one is that of ``official`` (release, artist)
    for their most frequent release, by ``names`` (source_name, library_name) as the
    library spells it, or without any release the most frequent one. A release that
    ``official`` has no answer for leaves its group as it is. Ties go to the smaller value.
    """
    key = ["release_group", "album_key"]
    known = tracks.where("coalesce(release_group, '') <> ''").withColumns({"album_artist": F.coalesce("album_artist", F.lit("")), "release": F.coalesce("release", F.lit(""))})
    facts = known.groupBy(*key).agg(F.min("album_artist").alias("_a"), F.max("album_artist").alias("_b")).where("_a <> _b").select(*key)
    artist = consensus.majority(known, key, "album_artist").select(*key, F.col("winner").alias("_usual"))
    release = consensus.majority(known, key, "release").select(*key, F.col("winner").alias("release"))
    facts = facts.join(artist, key).join(release, key).join(official.select("release", F.col("artist").alias("_official")), "release", "left")
    if names is not None:
        facts = facts.join(names.select(F.col("source_name").alias("_official"), "library_name"), "_official", "left").withColumn("_official", F.coalesce("library_name", "_official"))
    facts = facts.where("release = '' or _official is not null").select(*key, F.when(F.col("release") == "", F.col("_usual")).otherwise(F.coalesce(F.nullif("_official", F.lit("")), "_usual")).alias("new"))
    folders = known.select(*key, "folder").distinct()
    without = tracks.where("coalesce(release_group, '') = ''").select("path", "folder", "album_key", F.coalesce("album_artist", F.lit("")).alias("old"))
    siblings = without.join(folders, ["folder", "album_key"]).select(*key, "path", "old")
    rows = known.select(*key, "path", F.col("album_artist").alias("old")).unionByName(siblings).join(facts, key)
    return rows.where("old <> new").select(*key, "path", "old", "new")


def best_release(releases: DataFrame, recording: str, release: str, official: str, date: str) -> DataFrame:
    """(recording, release): an official release before others, then the oldest; one without a date comes last, ties by id."""
    order = F.struct(~F.coalesce(F.col(official), F.lit(False)), F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("9999")), F.col(release))
    return releases.groupBy(recording).agg(F.min_by(release, order).alias(release))


def better_cover(candidates: DataFrame, group: str, id_col: str, width: str, height: str, distance: str, current: str, most_bits: int = 20, wanted: int = 1000) -> DataFrame:
    """(group, cover): of the candidates that look like the present cover, are square within 5 % and larger than it (``current``: its side), one of ``wanted`` pixels or more first, then the nearest look, then the largest."""
    side = F.least(width, height)
    fits = (F.col(distance) <= most_bits) & (F.abs(F.col(width) - F.col(height)) <= 0.05 * F.greatest(width, height)) & (side > F.col(current))
    order = F.struct(side < wanted, F.col(distance), -side, F.col(id_col))
    return candidates.where(fits).groupBy(group).agg(F.min_by(id_col, order).alias("cover"))


def find(df: DataFrame, text: Column, query: str, most: int = 40, order: Sequence[str] = ()) -> DataFrame:
    """The first ``most`` rows, by ``order``, whose plain text holds every word of the query."""
    from sieveworks.functions import keys

    here = keys.plain(text)
    for word in query.split():
        df = df.where(F.contains(here, keys.plain(F.lit(word))))
    return df.orderBy(*order).limit(most)
