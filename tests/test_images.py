"""Image paths by their ends against trying every known path in order."""

import random

from pyspark.sql import functions as F

from lectern.operators import books


def test_first_match_in_order(spark):
    r = random.Random(2)
    name = lambda: "/".join("".join(r.choices("ab", k=r.randrange(1, 3))) for _ in range(r.randrange(1, 4)))
    images = [(b, i, name() if r.random() < 0.95 else r.choice(["", None]), f"/w/{b}{i}") for b in ("x", "y") for i in range(25)]
    sources = [(k, r.choice(["x", "y", "z", None]), r.choice([name(), "../" + name(), "a", None, "", "é/ü.png"])) for k in range(200)]
    known = {b: [(p, w) for bb, _, p, w in images if bb == b and p] for b in ("x", "y")}
    want = {k: (books.resolve(s, known.get(b, [])) if s else None) for k, b, s in sources}
    mixed = images[:]
    r.shuffle(mixed)
    df = spark.createDataFrame(sources, "k int, book string, src string").withColumn("web_path", F.lit("mine"))
    out = books.image_paths(df, spark.createDataFrame(mixed, "book string, ordinal int, package_path string, web_path string"))
    assert out.columns == [*df.columns, "image_path"] and {x.k: x.image_path for x in out.collect()} == want


def test_a_book_of_many_images(spark):
    images = spark.range(100_000).select(F.lit("b").alias("book"), F.col("id").alias("ordinal"), F.concat(F.lit("OEBPS/images/fig"), "id", F.lit(".png")).alias("package_path"), F.concat(F.lit("/w/"), "id").alias("web_path"))
    sources = spark.range(5000).select("id", F.lit("b").alias("book"), F.concat(F.lit("images/fig"), F.col("id") * 20, F.lit(".png")).alias("src"))
    out = books.image_paths(sources, images)
    assert out.where(F.col("image_path") == F.concat(F.lit("/w/"), (F.col("id") * 20).cast("string"))).count() == 5000
