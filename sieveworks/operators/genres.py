"""Genres of artists by vote.

Songs vote with the genre that a source gives them, translated. Artists vote by name,
collections of various artists by album, soundtracks by the artist of the song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import keys
from sieveworks.operators.consensus import two_votes

# The genres that are used, and the names that sources have for each.
GENRES = {
    "Rock": ("Hard Rock", "Rock & Alternative", "Alternative Rock", "Indie Rock", "Power Pop", "Rock y Alternativo"),
    "Latin Rock": ("Rock Latino",),
    "Metal": (),
    "Alternative": ("Neo-Psychedelia", "Indie Pop", "Vaihtoehtoinen", "Alternativo"),
    "Pop": ("French Pop", "J-Pop", "K-Pop", "Punjabi Pop", "Arabic Pop", "Holiday", "Musicals", "Vocal", "Easy Listening"),
    "Hip Hop": ("Rap/Hip Hop", "Conscious Hip Hop", "Hip-Hop/Rap"),
    "R&B": ("Soul & Funk", "Disco", "R&B/Soul", "R&B / Soul"),
    "Electronic": ("Electro", "Dance", "House", "Afro House", "Elektro", "Electronica"),
    "Latin": ("Latin Music", "Latin Pop", "Pop latino", "Pop Latino", "Latino"),
    "Reggaeton": ("Latin Urban", "Latin Rap", "Urbano latino", "Reggaetón"),
    "Tropical": ("Tropical Music", "Salsa", "Música tropical", "Bolero"),
    "Mexican": ("Mexican Music", "Ranchera", "Traditional Mexican", "Traditional Mexicano", "Música Mexicana"),
    "Flamenco": (),
    "Reggae": ("Roots Reggae",),
    "Country": ("Folk", "Americana", "Singer & Songwriter", "Singer/Songwriter", "Roots", "Raíces", "Country / Folk"),
    "Jazz": ("Jazz / Blues",),
    "Classical": ("Classical Crossover", "Orchestral", "Instrumental", "New Age", "Meditation", "Clásica"),
    "Soundtrack": ("アニメ", "サウンドトラック", "Films/Games", "Original Score", "Video Game", "Anime", "TV Soundtrack", "Películas/Juegos"),
    "Kids": ("Children's Music", "Lullabies", "Infantil"),
    "World": ("Worldwide", "African Music", "Asian Music", "Arabic", "Brazilian Music", "Brazilian", "Afrobeats", "Sports", "Música Asiática", "Música Brasileña", "Música Africana", "Deportes"),
}
# Genres that win over the ones that a source calls them by, and second genres that tell nothing beside a first.
PREVAILS = {"Reggaeton": ("Hip Hop", "Latin"), "Tropical": ("Latin", "Pop")}
IGNORED = {"Reggaeton": ("Hip Hop", "Latin"), "Tropical": ("Latin", "Pop")}
# Names of collections of various artists, as keys, and of soundtracks.
VARIOUS, SOUNDTRACKS, SOUNDTRACK = ("variousartists", "variosartistas"), "Soundtracks", "Soundtrack"


def genre_of(source: Column) -> Column:
    """The genre that a source's name stands for; null for an unknown name."""
    pairs = [x for genre, names in GENRES.items() for name in (genre, *names) for x in (F.lit(name), F.lit(genre))]
    return F.try_element_at(F.create_map(*pairs), source)


def voters(songs: DataFrame, album_artist: str, track_artist: str, album: str) -> DataFrame:
    """``songs`` with who votes: ``kind`` (artist, album or soundtrack) and ``name``; an unknown name is '?'."""
    artist = F.coalesce(album_artist, track_artist, F.lit("?"))
    various, film = keys.key(artist).isin(*VARIOUS), artist == SOUNDTRACKS
    kind = F.when(film, "soundtrack").when(various, "album").otherwise("artist")
    name = F.when(film, F.coalesce(track_artist, F.lit("?"))).when(various, F.coalesce(album, F.lit(""))).otherwise(artist)
    return songs.withColumns({"kind": kind, "name": name})


def choose(songs: DataFrame, fixed: DataFrame, genre: str = "genre") -> DataFrame:
    """(kind, name, genres, doubtful) of every voter of ``songs`` (kind, name and a translated genre or null).

    An artist of ``fixed`` (name, fixed) has that one genre, also without any vote. Others
    have their first and second choice. Soundtracks have those of their artist where he
    has any, else their own, and then 'Soundtrack'. Voters without a genre are left out.
    """
    on = ["kind", "name"]
    votes = two_votes(songs.where(F.col(genre).isNotNull()), on, genre, prevails=PREVAILS, ignored=IGNORED)
    voted = votes.select(*on, F.array_compact(F.array("first", "second")).alias("genres"), "doubtful")
    given = fixed.select(F.lit("artist").alias("kind"), "name", "fixed")
    decided = voted.join(given, on, "full_outer").select(*on, F.when(F.col("fixed").isNotNull(), F.array("fixed")).otherwise(F.col("genres")).alias("genres"), (F.coalesce("doubtful", F.lit(False)) & F.col("fixed").isNull()).alias("doubtful"))
    artists = decided.where("kind = 'artist'").select("name", F.col("genres").alias("of_artist"))
    films = songs.where("kind = 'soundtrack'").select(*on).distinct().join(decided, on, "left").join(artists, "name", "left")
    base = F.slice(F.filter(F.coalesce("of_artist", "genres"), lambda g: g != SOUNDTRACK), 1, 2)
    films = films.where("of_artist is not null or genres is not null").select(*on, F.concat(base, F.array(F.lit(SOUNDTRACK))).alias("genres"), F.coalesce("doubtful", F.lit(False)).alias("doubtful"))
    return decided.where("kind <> 'soundtrack'").unionByName(films)
