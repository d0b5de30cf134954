"""Audit sections: queries that emit violations in one schema.

Every section gives (section, severity, key, detail); severity is fix, decide or info.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import keys, similarity, tolerance
from sieveworks.operators import match

SCHEMA = "section string, severity string, key string, detail string"
MINIMUM_SECONDS, MAXIMUM_SECONDS = 20, 1200


def section(name: str, severity: str, rows: DataFrame, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("section"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union(sections: Iterable[DataFrame]) -> DataFrame:
    """All violations in one table."""
    out = None
    for s in sections:
        out = s if out is None else out.unionByName(s)
    return out


def tallies(violations: DataFrame) -> DataFrame:
    """Violations by section and severity."""
    return violations.groupBy("section", "severity").agg(F.count("*").alias("n"))


def totals(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """One row: all rows as ``total``, and those for which each condition holds; an empty table has zeros."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(test).alias(name) for name, test in wanted.items()))


def texts(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Broken text in tags."""
    pairs = F.array(*(F.struct(F.lit(c).alias("tag"), F.col(c).alias("value")) for c in columns))
    rows = df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("t")).withColumn("problem", keys.text_problem(F.col("t.value")))
    return section("odd text", "fix", rows.where("problem is not null"), F.col("id"), F.concat_ws(": ", "t.tag", "problem"))


def codes(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """Codes that aren't ISRCs."""
    return section("odd isrc", "fix", df.where(~keys.is_isrc(F.col(code))), F.col(id_col), F.col(code))


def dates(df: DataFrame, id_col: str, date: str, last_year: int) -> DataFrame:
    rows = df.withColumn("_problem", keys.date_problem(F.col(date), last_year)).where("_problem is not null")
    return section("odd date", "fix", rows, F.col(id_col), F.col("_problem"))


def durations(df: DataFrame, id_col: str, seconds: str) -> DataFrame:
    """Songs under 20 seconds or over 20 minutes."""
    rows = df.where((F.col(seconds) < MINIMUM_SECONDS) | (F.col(seconds) > MAXIMUM_SECONDS))
    return section("odd duration", "decide", rows, F.col(id_col), F.round(seconds, 1))


def basics(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Missing basic tags."""
    absent = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in columns)))
    rows = df.withColumn("_absent", absent).where(F.size("_absent") > 0)
    return section("missing tags", "fix", rows, F.col(id_col), F.array_join("_absent", ","))


def several_values(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Tags (arrays) with several values where one belongs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("tag"), F.col(c).alias("values")) for c in columns))
    rows = df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("t")).where(F.size("t.values") > 1)
    return section("several values", "fix", rows, F.col("id"), F.concat_ws(": ", "t.tag", F.array_join("t.values", " ; ")))


def hardlinks(df: DataFrame, path: str, inode: str) -> DataFrame:
    """Audio with several names."""
    rows = df.groupBy(inode).agg(F.min(path).alias("path"), F.count("*").alias("n")).where("n > 1")
    return section("hardlinks", "info", rows, F.col("path"), F.col("n"))


def repeated_positions(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positions that several rows have."""
    rows = df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    return section("repeated position", "fix", rows, F.concat_ws("/", *(F.col(c).cast("string") for c in by)), F.col("n"))


def mixed(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups whose rows should agree in a value and don't."""
    rows = df.groupBy(by).agg(F.countDistinct(value).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("seen")).where("n > 1")
    return section(f"mixed {value}", "fix", rows, F.col(by), F.col("seen"))


def outside(df: DataFrame, id_col: str, value: str, allowed: Sequence[str]) -> DataFrame:
    """Values that are empty or not in the list."""
    rows = df.where(~F.coalesce(F.col(value).isin(*allowed), F.lit(False)))
    return section(f"{value} outside list", "fix", rows, F.col(id_col), F.coalesce(value, F.lit("")))


def lyrics(df: DataFrame, id_col: str, text: str, seconds: str, instrumental: str | None = None) -> DataFrame:
    """Lyrics whose last mark lies more than 5 s (info) or 12 s (fix) behind the song's end, that have no marks, or that are missing; of songs marked ``instrumental`` none are missing."""
    silent = F.coalesce(F.col(instrumental), F.lit(False)) if instrumental else F.lit(False)
    rows = df.withColumn("_last", F.array_max(keys.lyric_marks(F.col(text))))
    over = F.col("_last") - F.col(seconds)
    name = (
        F.when(F.coalesce(F.col(text), F.lit("")) == "", F.when(~silent, "lyrics missing"))
        .when(F.col("_last").isNull(), "lyrics without marks")
        .when(over > 12, "lyrics too long")
        .when(over > 5, "lyrics slightly long")
    )
    rows = rows.withColumn("_name", name).where("_name is not null")
    severity = F.when(F.col("_name") == "lyrics too long", "fix").otherwise("info")
    return rows.select(F.col("_name").alias("section"), severity.alias("severity"), F.col(id_col).cast("string").alias("key"), F.round("_last", 2).cast("string").alias("detail"))


def covers(df: DataFrame, id_col: str, pictures: str) -> DataFrame:
    """Cover problems from an array of (type, w, h): none, not readable, too small (under 290), small (under 500), not square, no front (type 3), several. The first front counts, else the first picture."""
    fronts = F.filter(pictures, lambda p: p["type"] == 3)
    first = F.coalesce(F.try_element_at(fronts, F.lit(1)), F.try_element_at(F.col(pictures), F.lit(1)))
    readable = (F.coalesce(first["w"], F.lit(0)) > 0) & (F.coalesce(first["h"], F.lit(0)) > 0)
    side = F.when(readable, F.least(first["w"], first["h"]))
    name = F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(pictures), F.lit(0)) == 0, "cover missing"),
            F.when((F.size(pictures) > 0) & ~readable, "cover not readable"),
            F.when(side < 290, "cover too small"),
            F.when((side >= 290) & (side < 500), "cover small"),
            F.when(readable & (F.abs(first["w"] - first["h"]) > 0.05 * F.greatest(first["w"], first["h"])), "cover not square"),
            F.when((F.size(pictures) > 0) & (F.size(fronts) == 0), "cover not a front"),
            F.when(F.size(pictures) > 1, "several covers"),
        )
    )
    rows = df.select(F.col(id_col).cast("string").alias("key"), F.explode(name).alias("section"))
    return rows.select("section", F.when(F.col("section").isin("cover missing", "cover too small"), "fix").otherwise("info").alias("severity"), "key", F.lit(None).cast("string").alias("detail"))


def albums_alike(df: DataFrame, artist: str, folder: str, exceptions: DataFrame, release_groups: str | None = None) -> DataFrame:
    """Pairs of one artist's album folders (YYYY - Name) that may be one album; pairs of the exception table (folder_1, folder_2) in either order are left out.

    misspelled: the same name but for signs, or names of one year that are 0.9 alike and
    differ in more than digits; editions: the same name but for edition words; same
    release group: they share a member of ``release_groups`` (an array). The first that
    holds counts. Folders meet by name, by year and grams of their names, or by release
    group, so the many folders of an artist aren't all compared with each other.
    """
    rows = df.select(F.col(artist).alias("artist"), F.col(folder).alias("folder"), (F.col(release_groups) if release_groups else F.array().cast("array<string>")).alias("groups"))
    rows = rows.groupBy("artist", "folder").agg(F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups"))
    rows = rows.withColumns({"core": keys.album_core(F.regexp_replace("folder", "^[0-9]{4} - ", "")), "flat": F.regexp_replace(keys.plain(F.col("folder")), r"[\s_()\[\].,:;'’!?¿¡-]", ""), "year": F.substr("folder", F.lit(1), F.lit(4))}).where("core <> '' and artist is not null")

    def pairs(table: DataFrame, by: list[str]) -> DataFrame:
        other = table.select(*by, F.col("folder").alias("b"), F.col("flat").alias("flat_b"))
        return table.withColumnRenamed("folder", "a").join(other, by).where("a < b")

    kind = lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("kind"))
    named = pairs(rows, ["artist", "core"]).select("artist", "a", "b", F.when(F.col("flat") == F.col("flat_b"), kind(0, "misspelled")).otherwise(kind(1, "editions")).alias("k"))
    grouped = pairs(rows.select("artist", "folder", "flat", F.explode("groups").alias("group")), ["artist", "group"]).select("artist", "a", "b", kind(3, "same release group").alias("k"))
    split = "\u0001"
    years = rows.select(F.concat_ws(split, "artist", "folder").alias("id"), "core", F.concat_ws(split, "artist", "year").alias("block"))
    close = match.similar_names(years, "id", "core", "block", least_chars=6).select(F.split("a", split).alias("x"), F.split("b", split).alias("y"))
    close = close.select(F.col("x")[0].alias("artist"), F.least(F.col("x")[1], F.col("y")[1]).alias("a"), F.greatest(F.col("x")[1], F.col("y")[1]).alias("b"))
    letters = rows.select("artist", "folder", F.regexp_replace("core", "[0-9]", "").alias("letters"))
    close = close.join(letters.withColumnsRenamed({"folder": "a", "letters": "_a"}), ["artist", "a"]).join(letters.withColumnsRenamed({"folder": "b", "letters": "_b"}), ["artist", "b"]).where("_a <> _b").select("artist", "a", "b", kind(2, "misspelled").alias("k"))
    known = exceptions.select(F.least("folder_1", "folder_2").alias("a"), F.greatest("folder_1", "folder_2").alias("b"))
    found = named.unionByName(grouped).unionByName(close).groupBy("artist", "a", "b").agg(F.min("k").alias("k")).join(known, ["a", "b"], "left_anti")
    severity = F.when(F.col("k.kind") == "misspelled", "fix").when(F.col("k.kind") == "editions", "decide").otherwise("info")
    return found.select(F.lit("albums alike").alias("section"), severity.alias("severity"), F.concat_ws(" | ", "a", "b").alias("key"), F.col("k.kind").alias("detail"))


def folder_artists(df: DataFrame, folder: str, album_artist: str, artists: str) -> DataFrame:
    """Album folders (artist/album) some of whose songs have another album artist: to decide, or info where the folder's artist sings in the album, as one of the ``artists`` (an array) of a song.

    ``album_artist`` (null or empty: the first of ``artists``) is compared as a folder's
    name, regardless of case. The detail lists the other artists with their songs, most first.
    """
    top = F.split(F.col(folder), "/")[0]
    who = F.coalesce(F.nullif(F.col(album_artist), F.lit("")), F.get(artists, F.lit(0)))
    rows = df.select(F.col(folder).alias("folder"), top.alias("top"), who.alias("who"), F.transform(F.coalesce(artists, F.array().cast("array<string>")), lambda a: keys.plain(keys.clean_dir(a))).alias("sung"))
    sings = rows.groupBy("folder").agg(F.max(F.array_contains("sung", keys.plain(F.col("top")))).alias("sings"), F.count("*").alias("songs"))
    other = rows.where((F.coalesce("who", F.lit("")) != "") & (F.lower(keys.clean_dir(F.col("who"))) != F.lower("top"))).groupBy("folder", "who").agg(F.count("*").alias("n"))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "who"))), lambda x: F.concat(x["who"], F.lit("×"), (-x["n"]).cast("string"))), " / ")
    found = other.groupBy("folder").agg(seen.alias("seen"), F.sum("n").alias("n")).join(sings, "folder")
    name, severity = (F.when(F.col("sings"), yes).otherwise(no) for yes, no in (("folder of a singing artist", "folder of another artist"), ("info", "decide")))
    return found.select(name.alias("section"), severity.alias("severity"), F.col("folder").alias("key"), F.concat("seen", F.lit("; "), F.col("n").cast("string"), F.lit(" of "), F.col("songs").cast("string")).alias("detail"))


def artists_alike(df: DataFrame, artist: str, distinct: DataFrame) -> DataFrame:
    """Pairs of artist folders with the same name but for signs and a leading 'the', or names of 5 characters or more that are 0.9 alike; pairs of ``distinct`` (artist_1, artist_2) in either order are left out."""
    names = df.select(F.col(artist).alias("id"), keys.artist_without_the(F.col(artist)).alias("name")).where("name <> ''").distinct()
    equal = names.join(names.select(F.col("id").alias("b"), "name"), "name").where("id < b").select(F.col("id").alias("a"), "b")
    pairs = match.similar_names(names, "id", "name").select("a", "b").unionByName(equal)
    known = distinct.select(F.least("artist_1", "artist_2").alias("a"), F.greatest("artist_1", "artist_2").alias("b"))
    return section("artists alike", "decide", pairs.join(known, ["a", "b"], "left_anti"), F.concat_ws(" | ", "a", "b"), F.lit("nearly the same name"))


def damaged(df: DataFrame, id_col: str, code: str, message: str) -> DataFrame:
    """Files that failed the test of their audio (a code other than 0)."""
    return section("damaged", "fix", df.where(F.col(code) != 0), F.col(id_col), F.col(message))


def unreadable(df: DataFrame, id_col: str, error: str) -> DataFrame:
    return section("unreadable", "fix", df.where(F.coalesce(F.col(error), F.lit("")) != ""), F.col(id_col), F.col(error))


def unsigned(df: DataFrame, id_col: str, md5: str) -> DataFrame:
    """Files without a checksum of their audio."""
    return section("no checksum", "info", df.where(~F.coalesce(md5, F.lit(False))), F.col(id_col), F.lit(None))


def lossy_files(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Songs in a format that loses quality; ``label`` names it, null or empty where none is lost."""
    return section("lossy", "info", df.where(F.coalesce(F.col(label), F.lit("")) != ""), F.col(id_col), F.col(label))


def empty_folders(folders: DataFrame, files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """Folders in which, at any depth, no file stands."""
    parts = F.split(path, "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias(folder)).distinct()
    return section("empty folder", "fix", folders.select(folder).distinct().join(above, folder, "left_anti"), F.col(folder), F.lit(None))


def other_files(files: DataFrame, path: str, is_audio: Column) -> DataFrame:
    """Files in the library that aren't audio."""
    return section("not audio", "fix", files.where(~is_audio), F.col(path), F.lit(None))


def artists_of_many_genres(df: DataFrame, artist: str, track_artist: str, genres: str, soundtracks: str = "Soundtracks", various: Sequence[str] = ("variousartists", "variosartistas"), most: int = 2) -> DataFrame:
    """Artists whose songs have more than ``most`` genres together; a soundtrack counts for its song's artist and without the genre 'Soundtrack', collections of various artists don't count."""
    of_film = F.col(artist) == soundtracks
    rows = df.where(~keys.key(F.col(artist)).isin(*various)).select(F.when(of_film, F.concat(F.lit(f"{soundtracks}: "), F.coalesce(track_artist, F.lit("")))).otherwise(F.col(artist)).alias("artist"), of_film.alias("film"), F.explode(genres).alias("genre"))
    rows = rows.where(~(F.col("film") & (F.col("genre") == "Soundtrack"))).select("artist", "genre").distinct()
    many = rows.groupBy("artist").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("genre")), " ; ").alias("seen")).where(F.col("n") > most)
    return section("many genres", "fix", many, F.col("artist"), F.col("seen"))


def lyrics_of_instrumentals(df: DataFrame, id_col: str, text: str, instrumental: str) -> DataFrame:
    """Songs marked as instrumental that have lyrics."""
    return section("instrumental with lyrics", "fix", df.where((F.coalesce(F.col(text), F.lit("")) != "") & F.coalesce(F.col(instrumental), F.lit(False))), F.col(id_col), F.lit(None))


def mixed_covers(df: DataFrame, album: str, cover: str) -> DataFrame:
    """Albums whose songs have different covers, and how many songs each has."""
    votes = df.where(F.col(cover).isNotNull()).groupBy(F.col(album).alias("album"), F.col(cover).cast("string").alias("cover")).agg(F.count("*").alias("n"))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cover"))), lambda x: F.concat(x["cover"], F.lit("×"), (-x["n"]).cast("string"))), " / ")
    return section("mixed covers", "fix", votes.groupBy("album").agg(F.count("*").alias("kinds"), seen.alias("seen")).where("kinds > 1"), F.col("album"), F.col("seen"))


def foreign_releases(df: DataFrame, id_col: str, album: str, release: str) -> DataFrame:
    """Songs whose release has another name than their album: neither base name holds the other, and as titles they have nothing in common."""
    a, b = keys.album_base(F.col(album)), keys.album_base(F.col(release))
    rows = df.where((a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a))
    return section("foreign release", "decide", match.title_level(rows, album, release, "_level").where("_level = 0"), F.col(id_col), F.concat_ws(" | ", album, release))


def foreign_recordings(df: DataFrame, id_col: str, title: str, rec_title: str, seconds: str, rec_seconds: str, isrcs: str, rec_isrcs: str) -> DataFrame:
    """Songs whose recording is another one by title, duration and ISRC."""
    rows = match.same_recording(match.title_level(df, title, rec_title, "_level"), "_level", seconds, rec_seconds, isrcs, rec_isrcs, out="_same")
    return section("foreign recording", "fix", rows.where("not _same"), F.col(id_col), F.col("reason"))


def player_albums(media: DataFrame, albums: DataFrame, path: str = "path", album_id: str = "album_id") -> DataFrame:
    """Folders that a player shows as several albums (fix), and albums that it puts together from several folders: of one artist (fix), or of several (info). ``media`` has only rows whose file is there."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    rows = media.select(folder.alias("folder"), F.col(album_id).alias("id")).distinct().join(albums.select("id", F.col("name").alias("_name")), "id", "left").withColumn("name", F.coalesce("_name", "id"))
    split = rows.groupBy("folder").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), " / ").alias("seen")).where("n > 1")
    joined = rows.groupBy("id", "name").agg(F.count("*").alias("n"), F.countDistinct(F.split("folder", "/")[0]).alias("artists"), F.array_join(F.array_sort(F.collect_list("folder")), " | ").alias("seen")).where("n > 1")
    ours = joined.where("artists < n")
    return union([section("split folder", "fix", split, F.col("folder"), F.col("seen")), section("joined folders", "fix", ours, F.col("name"), F.col("seen")), section("album of several artists", "info", joined.where("artists = n"), F.col("name"), F.col("seen"))])


def paths(df: DataFrame, path: str = "path", number: str = "tracknumber", date: str = "date", album: str = "album", artist: str = "albumartist") -> DataFrame:
    """Paths that don't read ``Artist/YYYY - Album/NN - Title.ext`` or disagree with the tags. Names are compared by key, and what a path or tag doesn't say disagrees with nothing."""
    parts = F.split(F.col(path), "/")
    rows = df.withColumns({"_artist": F.try_element_at(parts, F.lit(-3)), "_folder": F.try_element_at(parts, F.lit(-2)), "_file": F.try_element_at(parts, F.lit(-1))})
    in_file = F.when(F.col("_file").rlike(r"^[0-9]{2,3} - .+\.[A-Za-z0-9]+$"), keys.number_of(F.col("_file")))
    year = F.when(F.col("_folder").rlike("^[0-9]{4} - ."), keys.year_of(F.col("_folder")))
    name = F.regexp_replace("_folder", "^[0-9]{4} - ", "")
    unlike = lambda folder, tag: keys.key(folder) != keys.key(keys.clean_dir(tag))
    problems = {
        "outside pattern": ("fix", in_file.isNull(), F.col("_file")),
        "album without year": ("fix", year.isNull(), F.col("_folder")),
        "number unlike file": ("fix", in_file != keys.number_of(F.col(number)), F.col(number)),
        "year unlike folder": ("fix", year != keys.year_of(F.col(date)), F.col(date)),
        "album unlike folder": ("decide", (F.col(album) != "") & unlike(name, F.col(album)), F.col(album)),
        "artist unlike folder": ("decide", (F.col(artist) != "") & unlike(F.col("_artist"), F.col(artist)), F.col(artist)),
    }
    found = [F.when(when, F.struct(F.lit(title).alias("section"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))) for title, (severity, when, detail) in problems.items()]
    rows = rows.select(F.col(path).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select("v.section", "v.severity", "key", "v.detail")


def private_data(df: DataFrame, id_col: str, text: str, allowed: str | None = keys.ALLOWED) -> DataFrame:
    """(id, line, kind, found): private data in texts, line by line, what matches ``allowed`` left out."""
    some = F.col(text).rlike("|".join(keys.PRIVATE.values()))
    lines = df.where(some).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "value"))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found"))
    found = F.array(*(F.transform(F.regexp_extract_all("value", F.lit(f"({pattern})"), F.lit(1)), named(kind)) for kind, pattern in keys.PRIVATE.items()))
    rows = lines.select("id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.flatten(found)).alias("f")).select("id", "line", "f.kind", "f.found")
    return rows.where(~F.col("found").rlike(allowed)) if allowed else rows


def audio_pairs(pairs: DataFrame, score: str, same_song: str, shared_id: str, seconds_a: str, seconds_b: str, preview_a: str, preview_b: str, same_title: str) -> DataFrame:
    """``verdict`` on scored pairs of songs, null where there is nothing to say.

    The same audio (a score of 0.9 or more) is copies where title, artist and duration
    agree. Else previews decide: under 0.8 on one side it has the wrong audio; without two
    good ones (0.85) it can't be told; with them and at 0.98 and the same duration it is
    copies or the same audio under two names; else parts or edits that share audio. Other
    audio (under 0.75) with a shared id and other titles is a wrong id. The rest that
    shares an id or name is versions.
    """
    s, a, b = F.col(score), F.col(preview_a), F.col(preview_b)
    alike = tolerance.same_audit_length(F.col(seconds_a), F.col(seconds_b))
    bad = (a < tolerance.BAD_PREVIEW) | (b < tolerance.BAD_PREVIEW)
    good = (a >= tolerance.GOOD_PREVIEW) & (b >= tolerance.GOOD_PREVIEW)
    same = (
        F.when(F.col(same_song), "copies")
        .when(F.coalesce(bad, F.lit(False)), "wrong audio")
        .when(~F.coalesce(good, F.lit(False)), "same audio, unconfirmed")
        .when((s >= 0.98) & alike, F.when(F.col(same_title), "copies").otherwise("same audio, two names"))
        .otherwise("shared audio")
    )
    verdict = F.when(s >= tolerance.SAME_AUDIO, same).when((s < tolerance.OTHER_AUDIO) & F.col(shared_id) & ~F.col(same_song), "wrong id").when(s.isNotNull(), "versions")
    return pairs.withColumn("verdict", verdict)
