import unicodedata

from pyspark.sql import functions as F

from sparktide.functions import text as X
from sparktide.operators import rows


def by_hand(t):
    """Words by the definition: lower case, compatibility decomposition, letters only."""
    t = "".join(" emoji " if ord(c) > 0xFFFF else c for c in t).lower()
    kept = "".join(c if unicodedata.category(c) == "Ll" else " " for c in unicodedata.normalize("NFKD", t))
    return [w for w in kept.split() if not (len(w) > 1 and set(w) == {"x"}) and w not in X.ENGLISH]


def test_cleaning_follows_the_definition(spark):
    texts = ["Café crème, naïve façade", "ﬁne ﬂow ½ ℓ", "xx XXXX fox", "Ünïcode ŞİĞ ıI", "plain ascii text", "", "日本 текст ελληνικά άλφα", "smile 😀 there", "ǆ ŀ ŉ ſt ʹ", "á combined", "²³ m²"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.w for r in d.select("i", X.clean_english(F.col("t")).alias("w")).collect()}
    assert got.pop(99) is None
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_emoji_round_trip(spark):
    d = spark.createDataFrame([("a😀b 🎉",), ("none",), (None,)], "t string")
    enc = d.select(X.encode_emoji(F.col("t")).alias("e"))
    got = [r.w for r in enc.select(F.transform(X.words(F.col("e")), X.decode_emoji).alias("w")).collect()]
    assert got == [["a", "😀", "b", "🎉"], ["none"], None]


def test_grid_sample_keeps_every_cell_and_group(spark):
    pts = [(i, i % 3, float(i % 40), float(i // 40)) for i in range(4000)] + [(9000, 7, 39.0, 99.0)]
    d = spark.createDataFrame(pts, "doc_id bigint, topic_id int, x double, y double")
    got = rows.grid_sample(d, 200)
    n = got.count()
    assert got.columns == d.columns and 200 <= n < 2000
    assert got.where("topic_id = 7").count() == 1
    assert rows.grid_sample(d, 5000).count() == len(pts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.grid_sample(d.repartition(3), 200).collect()))
