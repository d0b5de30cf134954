"""Text keys as native Column expressions.

Everything here but :func:`exact_plain` stays inside code generation. A null text is an
empty one throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

# Qualifiers that don't make another recording, words of versions and editions.
SAME_RECORDING = (
    r"^(([0-9]{4} )?(digital(ly)? )?remaster(ed|izad[oa])?( [0-9]{4})?( version)?|radio edit|edit|single version"
    r"|album version|albm version|version (del )?album|original( mix| version)?|mono|stereo|explicit|clean"
    r"|bonus( track)?|from .*|feat\.? .*|ft\.? .*|with .*|con .*)$"
)
VERSION_WORDS = (
    "remix|rmx|mix|edit|version|live|envivo|directo|instrumental|acoustic|acustic|extended|dub|club"
    "|radio|rework|bootleg|cover|demo|reprise|sped|slowed|orchestral"
)
EDITION_TAIL = (
    r"(?i)\s*[\(\[][^\)\]]*[\)\]]|\s+-\s+.*$|\b(deluxe|expanded|remaster(ed)?|anniversary|edition|version"
    r"|bonus|special|super)\b.*$"
)
EDITION_WORDS = (
    r"\b(deluxe|edition|edicion|remaster(ed)?|remasterizado|expanded|anniversary|version|standard|"
    r"explicit|clean|bonus|special|super|legacy|collector'?s|reissue|mono|stereo|complete works|int'?l|international|[0-9]{4})\b"
)
ARTIST_BREAK = r"\s*(,|&|\bfeat\.?|\bft\.?|\bx\b|\bcon\b|\by\b)\s*"
CREDIT_SEPARATORS = (" • ", " · ", "; ", " feat. ", " featuring ", " ft. ", " ft ", " & ", " x ", " with ")
ROMAN = {"viii": "8", "vii": "7", "iii": "3", "vi": "6", "iv": "4", "ix": "9", "ii": "2", "x": "10", "v": "5", "i": "1"}

_BRACKETED = r"[\(\[][^\)\]]*[\)\]]"
_SIGNS = r"[^\p{L}\p{N}_]"


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters whose compatibility decomposition without marks is one other character, and those with none or several; Hangul, which follows a formula, left out."""
    one, several = {}, {}
    for code in [*range(0xD800), *range(0xE000, 0x30000)]:
        char = chr(code)
        if 0xAC00 <= code < 0xD7A4 or unicodedata.combining(char):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char:
            (one if len(base) == 1 else several)[char] = base
    return one, several


_ONE, _SEVERAL = _decompositions()
#: Characters to translate, and their translations; the marks behind them have none and go.
_ACCENTED, _BASE = "".join(_ONE) + "".join(chr(c) for c in range(0x30000) if unicodedata.combining(chr(c))), "".join(_ONE.values())
#: Characters that grow when they are decomposed, in either case, Hangul left out, and a few ranges that hold them all.
_GROWING = "".join(sorted({c for x in _SEVERAL for c in (x, x.upper()) if len(c) == 1}))
_MAY_GROW = r"[\u00BC-\u00BE\u0132\u0133\u013F\u0140\u0149\u01C4-\u01CC\u01F1-\u01F3\u0344-\x{2FFFF}]"
_PAIR, _ENTRY = "\x02", "\x01"
#: The parts of a Hangul syllable: first consonants, vowels, last consonants.
_HANGUL = tuple("".join(map(chr, x)) for x in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))


def _grown(text: Column) -> Column:
    """Characters that decompose into several, or none, spelled out one by one."""
    table = F.str_to_map(F.lit(_ENTRY.join(f"{a}{_PAIR}{b}" for a, b in _SEVERAL.items())), F.lit(_ENTRY), F.lit(_PAIR))

    def spelled(c: Column) -> Column:
        place = F.ascii(c) - 0xAC00
        syllable = F.concat(
            F.substr(F.lit(_HANGUL[0]), F.floor(place / 588).cast("int") + 1, F.lit(1)),
            F.substr(F.lit(_HANGUL[1]), F.floor(place % 588 / 28).cast("int") + 1, F.lit(1)),
            F.when(place % 28 > 0, F.substr(F.lit(_HANGUL[2]), place % 28, F.lit(1))).otherwise(""),
        )
        return F.when((c >= "\uac00") & (c <= "\ud7a3"), syllable).when(c > "\u00bb", F.coalesce(F.try_element_at(table, c), c)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), spelled), "")


def plain(text: Column) -> Column:
    """Lower-cased, in compatibility decomposition, without combining marks, in all scripts.

    Characters that stand for one other are translated; only texts with others go through
    their characters one by one.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    grows = text.rlike(_MAY_GROW) & (text.rlike("[\uac00-\ud7a3]") | (F.translate(text, _GROWING, "") != text))
    return F.translate(F.when(grows, _grown(lower)).otherwise(lower), _ACCENTED, _BASE)


@F.pandas_udf(T.StringType())
def exact_plain(text: pd.Series) -> pd.Series:
    """:func:`plain` outside the JVM, to hold it against."""
    return text.fillna("").map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)))


def letters(text: Column) -> Column:
    """Without anything but letters, digits and underscores."""
    return F.regexp_replace(text, _SIGNS, "")


def key(text: Column) -> Column:
    """'Pa-Kum-Pa!' -> 'pakumpa'."""
    return letters(plain(text))


def without_brackets(text: Column) -> Column:
    """'Thriller (Deluxe)' -> 'thriller'."""
    return letters(F.regexp_replace(plain(text), _BRACKETED, " "))


def base_title(text: Column) -> Column:
    """'Bohemian Rhapsody - Remastered 2011' -> 'bohemianrhapsody'."""
    return letters(F.regexp_replace(F.regexp_replace(plain(text), _BRACKETED, " "), r"\s+-\s+.*$", ""))


def first_artist(text: Column, spanish_and: bool = False) -> Column:
    """The first name of a credit list, as written.

    feat and ft count only as whole words, on purpose: inside words they would cut names
    such as 'Taylor Swift'.
    """
    tail = "| y " if spanish_and else ""
    return F.element_at(F.split(F.coalesce(text, F.lit("")), rf"(?i)\s*(,|&|\bfeat\b\.?|\bft\b\.?| x | con {tail})\s*", -1), 1)


def artist_key(text: Column) -> Column:
    """'Wisin & Yandel, Daddy Yankee' -> 'wisin'; a separator in front gives an empty key, which joins nothing."""
    return letters(F.element_at(F.split(plain(text), ARTIST_BREAK, -1), 1))


def title_key(text: Column) -> Column:
    """The title with those qualifiers that make another recording: base|qualifier|qualifier.

    'Bohemian Rhapsody - Remastered 2011' has the key of 'Bohemian Rhapsody'; a remix, a live
    take or an acoustic one has its own.
    """
    return _title_key(plain(text))


def _title_key(flat: Column) -> Column:
    """:func:`title_key` of plain text."""

    def key_of(flat: Column) -> Column:
        inside = F.regexp_extract_all(flat, F.lit(r"[\(\[]([^\)\]]*)[\)\]]"), F.lit(1))
        parts = F.transform(F.split(F.regexp_replace(flat, _BRACKETED, " "), " - ", -1), lambda x: F.trim(x))
        qualifiers = _bound(parts, lambda p: F.transform(F.concat(inside, F.slice(p, F.lit(2), F.size(p))), lambda x: F.trim(x)))
        other = F.filter(qualifiers, lambda q: (q != "") & ~q.rlike(SAME_RECORDING))
        kept = F.array_sort(F.array_distinct(F.transform(other, letters)))
        return F.concat(letters(parts[0]), _bound(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("|"), F.array_join(k, "|"))).otherwise("")))

    return _bound(flat, key_of)


def _bound(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function uses it."""
    return F.transform(F.array(value), function)[0]


def album_base(text: Column) -> Column:
    """'Thriller (25th Anniversary)' -> 'thriller'."""
    return key(F.regexp_replace(F.coalesce(text, F.lit("")), EDITION_TAIL, ""))


def album_core(text: Column) -> Column:
    """An album's name without edition words, with whatever else stands in brackets."""
    return letters(F.regexp_replace(plain(text), EDITION_WORDS, " "))


def artist_without_the(text: Column) -> Column:
    return F.regexp_replace(key(text), "^the", "")


def spelled_numbers(text: Column) -> Column:
    """:func:`plain` with ligatures written out, 'Pt.' as 'part' and Roman numerals after part, vol and the like as digits."""
    out = plain(text)
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("ø", "o"), ("ł", "l"), ("đ", "d")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\bpt\.?\s*", "part ")
    for roman, digits in ROMAN.items():
        out = F.regexp_replace(out, rf"\b(part|parte|vol|no|chapter|act)\.?\s+{roman}\b", f"$1 {digits}")
    return out


def spelled_key(text: Column) -> Column:
    """:func:`title_key` of :func:`spelled_numbers`."""
    return _title_key(spelled_numbers(text))


def version_qualifiers(text: Column) -> Column:
    """The qualifiers of a title that name a version, without a repeated base title."""

    def named(whole: Column) -> Column:
        base = whole[0]
        cut = F.transform(F.slice(whole, F.lit(2), F.size(whole)), lambda q: F.when((base != "") & q.startswith(base), F.substr(q, F.length(base) + 1)).otherwise(q))
        return F.filter(cut, lambda q: (q != "") & q.rlike(VERSION_WORDS))

    return _bound(F.split(spelled_key(text), r"\|", -1), named)


def version_words(text: Column) -> Column:
    """The distinct version words in a title's qualifiers."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(version_qualifiers(text), lambda q: F.regexp_extract_all(q, F.lit(f"({VERSION_WORDS})"), F.lit(1))))))


def title_parts(text: Column) -> Column:
    """The keys of what ' - ', ': ' and ' / ' separate."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+-\s+|:\s+|\s+/\s+|／", -1), lambda p: F.trim(p) != "")
    return F.transform(parts, spelled_key)


def non_latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]|\p{IsLatin}", ""))


def credited_artists(text: Column) -> Column:
    """Every artist of a credit."""
    out = F.coalesce(text, F.lit(""))
    for separator in CREDIT_SEPARATORS:
        out = F.replace(out, F.lit(separator), F.lit(","))
    return F.filter(F.transform(F.split(out, ","), lambda x: F.trim(x)), lambda a: a != "")


def store_artists(text: Column) -> Column:
    """The keys of the artists of a shop's credit."""
    names = F.filter(F.split(F.coalesce(text, F.lit("")), r",\s*|\s+&\s+|\s+feat\.?\s+|\s+x\s+", -1), lambda a: F.trim(a) != "")
    return F.array_distinct(F.transform(names, artist_key))


def store_base_title(text: Column) -> Column:
    """A shop's title up to the first credit, bracket or dash, lower-cased, without signs."""
    return letters(F.lower(F.element_at(F.split(F.coalesce(text, F.lit("")), r"(?i)\s+(?:feat\.?|ft\.?|with)\s+|\s*[(\[]|\s+-\s+", -1), 1)))


def credit_keys(artist: Column, title: Column) -> Column:
    """(artist_key, title_key) of every credited artist and of the credit as a whole."""
    names = F.concat(credited_artists(artist), F.array(F.coalesce(artist, F.lit(""))))
    return F.array_distinct(F.transform(names, lambda a: F.struct(artist_key(a).alias("artist_key"), title_key(title).alias("title_key"))))


def trimmed(text: Column) -> Column:
    """``text`` without white space of any kind at its edges."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean_title(text: Column) -> Column:
    """A title to look up lyrics with: without what follows a dash, and without brackets."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+-\s+.*$", ""), r"\s*[(\[][^)\]]*[)\]]", ""))


def resolved_path(folder: Column, path: Column) -> Column:
    """``path`` as seen from ``folder``, without steps up or in place; an absolute one stays so."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path))
    up = lambda kept, rooted: F.when((F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("")), kept), -1) != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(F.lit(".."))))
    rooted = whole.startswith("/")
    kept = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda kept, p: F.when(p.isin("", "."), kept).when(p == "..", up(kept, rooted)).otherwise(F.concat(kept, F.array(p))))
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))


def player_time(text: Column) -> Column:
    """An ISO time as a player's database writes it."""
    return F.concat(F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")), F.lit(".000000000+00:00"))


def clean_file(text: Column) -> Column:
    """A name that a file can have."""
    out = trimmed(F.translate(F.coalesce(text, F.lit("")), '/\\:*?"<>|', "_" * 9))
    return F.when(out == "", "_").otherwise(out)


def clean_dir(text: Column) -> Column:
    """As :func:`clean_file`, without dots and spaces at the end."""
    out = F.regexp_replace(trimmed(F.translate(F.coalesce(text, F.lit("")), '/\\:*?"<>|', "_" * 9)), r"[. ]+$", "")
    return F.when(out == "", "_").otherwise(out)


def year_of(text: Column) -> Column:
    """The four digits in front, or null."""
    return F.nullif(F.regexp_extract(F.trim(text), "^([0-9]{4})", 1), F.lit(""))


def number_of(text: Column) -> Column:
    """The digits in front as a number, or null."""
    return F.nullif(F.regexp_extract(F.trim(text), "^([0-9]+)", 1), F.lit("")).try_cast("int")


def cut_to_bytes(text: Column, most: int = 250) -> Column:
    """The longest start of ``text`` that takes at most so many bytes of UTF-8."""
    chars = F.split(text, "")
    size = lambda s: F.octet_length(s)
    cut = F.aggregate(
        chars,
        F.struct(F.lit("").alias("kept"), F.lit(False).alias("full")),
        lambda s, c: F.struct(
            F.when(s["full"] | (size(s["kept"]) + size(c) > most), s["kept"]).otherwise(F.concat(s["kept"], c)).alias("kept"),
            (s["full"] | (size(s["kept"]) + size(c) > most)).alias("full"),
        ),
    )["kept"]
    return F.when(size(text) <= most, text).otherwise(cut)


# Fixed value: characters that text in a wrong encoding shows.
BROKEN = "Ã[\u0080-¿]|Â[\u0080-¿ ]|â€|�|[\\x00-\\x08\\x0b-\\x1f]"
#: White space of Unicode.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def text_problem(text: Column) -> Column:
    """What is wrong with a tag's text: broken characters, white space at an edge, double spaces, HTML entities; null if nothing."""
    return (
        F.when(text.rlike(BROKEN), "broken characters")
        .when(text.rlike(f"^{BLANK}|{BLANK}$"), "edge spaces")
        .when(F.contains(text, F.lit("  ")), "double space")
        .when(text.rlike("&(apos|amp|quot|lt|gt|#[0-9]+);"), "HTML entity")
    )


def is_isrc(text: Column) -> Column:
    return text.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")


def date_problem(text: Column, last_year: int) -> Column:
    """What is wrong with a date YYYY[-MM[-DD]]; null if nothing or if there is none."""
    odd = ~text.rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$")
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(odd, "odd format").when((year < 1900) | (year > last_year), "year out of range")


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    import html

    return text.map(lambda x: html.unescape(html.unescape(x)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_each(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda x: [html.unescape(html.unescape(t)) for t in x], na_action="ignore")


def unescaped(text: Column) -> Column:
    """All HTML character references resolved, twice, as HTML 5 has them; only texts with an ampersand leave the JVM."""
    asked = text.contains("&")
    return F.when(asked, _unescape(F.when(asked, text))).otherwise(text)


def unescaped_each(texts: Column) -> Column:
    """:func:`unescaped` for an array."""
    asked = F.exists(texts, lambda t: t.contains("&"))
    return F.when(asked, _unescape_each(F.when(asked, texts))).otherwise(texts)


def link_id(text: Column) -> Column:
    """The last segment of a link or URI, without its query."""
    return F.regexp_extract(F.split(text, r"\?")[0], "([^/:]*)$", 1)


def lyric_marks(text: Column) -> Column:
    """The [mm:ss.xx] marks of a text in seconds."""
    marks = F.regexp_extract_all(text, F.lit(r"\[([0-9]+):[0-9]{2}(?:\.[0-9]+)?\]"), F.lit(1))
    rest = F.regexp_extract_all(text, F.lit(r"\[[0-9]+:([0-9]{2}(?:\.[0-9]+)?)\]"), F.lit(1))
    return F.zip_with(marks, rest, lambda m, s: m.cast("double") * 60 + s.cast("double"))


def iso_epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 UTC text with any number of decimals."""
    whole = F.try_to_timestamp(F.regexp_extract(text, r"^([0-9-]{10}[T ][0-9:]{8})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.unix_timestamp(whole).cast("double") + F.coalesce(F.regexp_extract(text, r"(\.[0-9]+)", 1).try_cast("double"), F.lit(0.0))


# Private data in texts, what it is and its pattern.
PRIVATE = {
    "e-mail": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+",
    "home network address": r"\b(?:192\.168|10\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "overlay network address": r"\b100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "home folder": r"/home/[A-Za-z0-9_]+",
}
# Matches that are allowed in documentation.
ALLOWED = "(?i)noreply|example|ejemplo|tu-correo|usuario@|you@"
