"""Photo relations made from the supplied tables, for Spark and, as SQL text, for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.functions.scores import dhash

#: Both engines take this text.
CATALOG_COLUMNS = """d.doc_id,
  concat('/lib/', lang, '/', CASE WHEN d.doc_id % 13 = 0 THEN 'disqualified/' ELSE '' END, source, '/', CAST(d.doc_id AS VARCHAR(20)),
    CASE CAST(d.doc_id % 9 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.cr2' WHEN 3 THEN '.NEF' WHEN 4 THEN '.webp'
      WHEN 5 THEN '.heic' WHEN 6 THEN '.txt' WHEN 7 THEN '.Tiff' ELSE '' END) AS path,
  CAST(n_chars AS DOUBLE) / CAST(20 AS DOUBLE) AS score,
  CAST(d.doc_id % 101 AS DOUBLE) AS exposure, CAST((d.doc_id * 7) % 101 AS DOUBLE) AS contrast,
  CAST((d.doc_id * 13) % 101 AS DOUBLE) AS color, CAST((d.doc_id * 17) % 101 AS DOUBLE) AS composition,
  CASE WHEN l.toxic IS NULL THEN NULL ELSE CAST((d.doc_id * 29) % 101 AS DOUBLE) END AS subject,
  CASE WHEN l.quality = 0 THEN true WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN false END AS manual_dq,
  CASE CAST(d.doc_id % 4 AS INT) WHEN 0 THEN 'Landscape' WHEN 1 THEN 'Portrait' WHEN 2 THEN 'Object' ELSE 'Animal' END AS mode"""

#: A text is shrunk to 8 rows of 9 cells: the code points of each of 72 spans of equal length (the last ones may be short), but for vowels and blanks.
SKIPPED = "aeiou "
_SPAN = "CAST((length(coalesce(text, '')) + 71) // 72 AS BIGINT)"
_CELL = f"length(translate(substr(coalesce(text, ''), CAST({{0}} * {_SPAN} + 1 AS BIGINT), {_SPAN}), 'aeiou ', ''))"
_HASH = """CAST((SELECT list_sum(list_transform(range(0, 64), lambda i: CASE WHEN c[(i // 8) * 9 + i % 8 + 1] > c[(i // 8) * 9 + i % 8 + 2]
  THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(i AS INT) END ELSE CAST(0 AS HUGEINT) END))) AS BIGINT)"""

CATALOG = f"""cells AS (SELECT *, list_transform(range(0, 72), lambda k: {_CELL.format('k')}) AS c FROM documents),
catalog AS (SELECT {CATALOG_COLUMNS}, {_HASH} AS phash FROM cells d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

OVERALL = """(CAST(CAST(0.25 AS FLOAT) AS DOUBLE) * (CASE WHEN score <= 0 THEN 0 ELSE 100 * score / (score + 100) END)
  + CAST(CAST(0.15 AS FLOAT) AS DOUBLE) * exposure + CAST(CAST(0.1 AS FLOAT) AS DOUBLE) * contrast + CAST(CAST(0.1 AS FLOAT) AS DOUBLE) * color
  + CAST(CAST(0.25 AS FLOAT) AS DOUBLE) * composition + coalesce(CAST(CAST(0.15 AS FLOAT) AS DOUBLE) * subject, 0))
  / (CAST(CAST(0.25 AS FLOAT) AS DOUBLE) + CAST(CAST(0.15 AS FLOAT) AS DOUBLE) + 2 * CAST(CAST(0.1 AS FLOAT) AS DOUBLE) + CAST(CAST(0.25 AS FLOAT) AS DOUBLE)
  + CASE WHEN subject IS NULL THEN 0 ELSE CAST(CAST(0.15 AS FLOAT) AS DOUBLE) END)"""

PIXELS = """emb_long AS (SELECT vec_id, i - 1 AS i, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
q AS (SELECT vec_id, i, CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.6) * 212.5), 0), 255) AS INT) AS p FROM emb_long),
pixels AS (SELECT a.vec_id AS photo_id, CAST(a.i % 8 AS INT) AS x, CAST(floor(a.i / 8) AS INT) AS y, a.p AS r, b.p AS g, c.p AS b
  FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.i = (a.i + 21) % 64 JOIN q c ON c.vec_id = a.vec_id AND c.i = (a.i + 42) % 64),
gray AS (SELECT *, CAST(floor((2126 * r + 7152 * g + 722 * b) / 10000) AS INT) AS gray FROM pixels)"""

#: Gray frames of 22 by 19, one of each embedding: turned tiles of its values.
WIDTH, HEIGHT = 22, 19
FRAMES = f"""grays AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.6) * 212.5), 0), 255) AS INT)) AS p FROM embeddings),
frames AS (SELECT vec_id AS photo_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, p[(x % 8 + 8 * (y % 8) + 5 * (x // 8) + 11 * (y // 8)) % 64 + 1] AS gray FROM grays, range(0, {WIDTH}) b(x), range(0, {HEIGHT}) c(y))"""


def lap(source: str) -> str:
    """Oracle text: ``lap`` over rows of ``photo_id, x, y, gray``."""
    return f"""lap AS (SELECT photo_id, x, y, coalesce(lag(gray) OVER (PARTITION BY photo_id, y ORDER BY x), gray) + coalesce(lead(gray) OVER (PARTITION BY photo_id, y ORDER BY x), gray)
  + coalesce(lag(gray) OVER (PARTITION BY photo_id, x ORDER BY y), gray) + coalesce(lead(gray) OVER (PARTITION BY photo_id, x ORDER BY y), gray) - 4 * gray AS lap FROM {source})"""


BOXES = """boxes AS (SELECT user_id AS photo_id, event_id AS box_id, CAST(value / 500 AS FLOAT) AS score,
  CAST((event_id * 7) % 80 AS FLOAT) AS x1, CAST((event_id * 11) % 80 AS FLOAT) AS y1,
  CAST((event_id * 7) % 80 + 5 + event_id % 40 AS FLOAT) AS x2, CAST((event_id * 11) % 80 + 5 + event_id % 30 AS FLOAT) AS y2 FROM events)"""
SCAN_EVENTS = """scan_events AS (SELECT event_id, ts, concat('/lib/', CAST(user_id AS VARCHAR(20)), '/', CAST(event_id AS VARCHAR(20)), '.jpg') AS path,
  CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Photo' END AS kind, CASE WHEN event_type = 'error' THEN props END AS error FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that stands for a photo."""
    text = F.coalesce("text", F.lit(""))
    span = F.format_string("(?s).{1,%d}", F.greatest(F.floor((F.length(text) + 71) / 72), F.lit(1)))
    cells = F.transform(F.regexp_extract_all(text, span, F.lit(0)), lambda part: F.length(F.translate(part, SKIPPED, "")))  # each text is read once
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", cells.alias("cells"))
    docs = docs.select("doc_id", "lang", "source", "n_chars", dhash([F.coalesce(F.get("cells", F.lit(i)), F.lit(0)) for i in range(72)]).alias("phash"))
    return spark.sql(f"SELECT {CATALOG_COLUMNS}, phash FROM {{docs}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id", docs=docs, labels=table(spark, sf_dir, "labels").hint("merge"))  # as many labels as photos are too many to broadcast


def _levels() -> Column:
    """An embedding's values as numbers from 0 to 255."""
    return F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.6) * 212.5), F.lit(0)), F.lit(255)).cast("int"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 colour pixels of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), _levels().alias("p"))
    rows = rows.select("photo_id", "p", F.posexplode("p").alias("i", "r"))

    def turned(by: int):
        return F.element_at("p", ((F.col("i") + by) % 64 + 1).cast("int"))

    return rows.select("photo_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "r", turned(21).alias("g"), turned(42).alias("b"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gray frame of each embedding, larger than a tile."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), _levels().alias("p"))
    rows = rows.select("photo_id", "p", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))).alias("i"))
    rows = rows.select("photo_id", "p", (F.col("i") % WIDTH).cast("int").alias("x"), F.floor(F.col("i") / WIDTH).cast("int").alias("y"))
    at = F.expr("(x % 8 + 8 * (y % 8) + 5 * (x div 8) + 11 * (y div 8)) % 64 + 1").cast("int")
    return rows.select("photo_id", "x", "y", F.element_at("p", at).alias("gray"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    f = lambda c: c.cast("float")
    x, y = (e * 7) % 80, (e * 11) % 80
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("photo_id"), e.alias("box_id"), f(F.col("value") / 500).alias("score"), f(x).alias("x1"), f(y).alias("y1"), f(x + 5 + e % 40).alias("x2"), f(y + 5 + e % 30).alias("y2"))


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/lib/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", "ts", path.alias("path"), F.when(failed, "Failed").otherwise("Photo").alias("kind"), F.when(failed, F.col("props")).alias("error"))
