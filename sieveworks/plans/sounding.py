"""Loudness and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import similarity, tolerance
from sieveworks.operators import match


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loudness_album_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as an album: discount stands for loudness, quantity for duration, tax for the peak."""
    items = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    out = items.agg(similarity.album_loudness(-100 * F.col("l_discount") - 5, F.col("l_quantity")).alias("lufs"), F.max(F.pow(F.lit(10.0), -100 * F.col("l_tax") / 20)).alias("peak"))
    return out.select("l_orderkey", F.round("lufs", 6).alias("lufs"), F.round(similarity.track_gain(F.col("lufs")), 6).alias("gain"), F.round("peak", 6).alias("peak"))


def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as files: the discount stands for loudness, the price for the size, the quantity for the declared length, of which the tax was cut off."""
    items = _t(spark, sf_dir, "lineitem")
    gain = similarity.track_gain(-F.round(F.col("l_discount") * 100) - 5)
    rows = items.select(similarity.gain_text(gain).alias("gain"), tolerance.cut_short(F.col("l_quantity") * 10 - F.round(F.col("l_tax") * 100) * 2, F.col("l_quantity") * 10).alias("short"), F.floor(similarity.bit_rate(F.floor("l_extendedprice") * 1000, F.col("l_quantity")) / 1000).alias("megabits"))
    return rows.groupBy("gain", "short", "megabits").agg(F.count("*").alias("n"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one that follows it by id."""
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id")


def hamming_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing signs of the components of neighbours."""
    sign = lambda c: similarity.packed_words(F.transform(c, lambda x: x > 0))
    return _neighbours(spark, sf_dir).select("vec_id", similarity.hamming_words(sign("embedding"), sign("next")).cast("long").alias("bits"))


def look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of vectors, each also with four or eight of its 64 turned: the looks that differ in at most 5 places."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("turned"))
    flip = lambda i: ((F.col("turned") == 1) & (i % 16 == F.col("vec_id") % 16)) | ((F.col("turned") == 2) & (i % 8 == F.col("vec_id") % 8))
    signs = similarity.packed_words(F.transform("embedding", lambda x, i: (x > 0) != flip(i)))
    looks = rows.select((F.col("vec_id") * 3 + F.col("turned")).alias("id"), signs.alias("words"))
    return match.look_alikes(looks, "id", "words", most_bits=5, bits=64)[1]


def _words(column: str):
    """Components as 32-bit words of a print."""
    return F.transform(column, lambda x: F.pmod(F.floor(x * 1000), F.lit(1 << 31)).cast("long"))


def preview_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 words of the next vector slid over a vector."""
    return _neighbours(spark, sf_dir).select("vec_id", similarity.preview_similarity(_words("embedding"), F.slice(_words("next"), 1, 20)).alias("similarity"))


def sliding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("vec_id", similarity.sliding_similarity(_words("embedding"), _words("next")).alias("similarity"))


def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's type names against the alphabetically first one of it."""
    part = _t(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    first = part.groupBy("p_brand").agg(F.min("p_type").alias("first"))
    return part.join(first, "p_brand").select("p_brand", "p_type", F.round(similarity.edit_similarity(F.col("p_type"), F.col("first")), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (loudness_album_gain, file_facts, hamming_similarity, look_alikes, preview_similarity, sliding_similarity, edit_similarity)}

_N = "with n as (select a.vec_id, a.embedding e, b.embedding f from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
ORACLE_SQL = {
    "loudness_album_gain": "with a as (select l_orderkey, 10 * log10(sum(l_quantity * pow(10, (-100 * l_discount - 5) / 10)) / sum(l_quantity)) lufs, max(pow(10, -100 * l_tax / 20)) peak from lineitem group by 1) select l_orderkey, round(lufs, 6) lufs, round(-18 - lufs, 6) gain, round(peak, 6) peak from a",
    "file_facts": """select printf('%+.2f dB', cast(-18 + round(l_discount * 100) + 5 as double)) gain, l_quantity * 10 - round(l_tax * 100) * 2 < l_quantity * 10 - greatest(2.0, 0.03 * (l_quantity * 10)) short,
      cast(floor(floor(l_extendedprice) * 1000 * 8 / l_quantity / 1000 / 1000) as bigint) megabits, count(*) n from lineitem group by all""",
    "hamming_similarity": f"{_N} select vec_id, cast(list_sum(list_transform(range(1, len(e) + 1), lambda i: case when (e[i] > 0) <> (f[i] > 0) then 1 else 0 end)) as bigint) bits from n",
    "look_alikes": """with t as (select vec_id, embedding, unnest([0, 1, 2]) as t from embeddings), f as (select vec_id * 3 + t as id, list_transform(range(len(embedding)), lambda i: (embedding[i + 1] > 0) <> (t = 1 and i % 16 = vec_id % 16 or t = 2 and i % 8 = vec_id % 8)) as w from t),
      s as (select w, min(id) as look, list_sum(list_transform(range(64), lambda i: case when w[i + 1] then cast(1 as hugeint) << i else 0 end))::hugeint as n from f group by 1)
      select * from (select a.look as a, b.look as b, cast(bit_count(xor(a.n, b.n)) as bigint) as bits from s a join s b on a.look < b.look) where bits <= 5""",
    "preview_similarity": f"""{_N}, w as (select vec_id, list_transform(e, lambda x: ((cast(floor(cast(x as float) * 1000) as bigint) % 2147483648) + 2147483648) % 2147483648) a, list_transform(f[1:20], lambda x: ((cast(floor(cast(x as float) * 1000) as bigint) % 2147483648) + 2147483648) % 2147483648) b from n)
      select vec_id, round(list_max(list_transform(range(0, len(a) - 18 + 1), lambda o: list_sum(list_transform(range(1, least(20, len(a) - o) + 1), lambda i: 32 - bit_count(xor(a[o + i], b[i])))) / (32.0 * least(20, len(a) - o)))), 3) similarity from w""",
    "edit_similarity": "with p as (select distinct p_brand, p_type from part), f as (select p_brand, min(p_type) m from p group by 1) select p_brand, p_type, round(1 - levenshtein(p_type, m) / greatest(len(p_type), len(m), 1), 6) similarity from p join f using (p_brand)",
}
