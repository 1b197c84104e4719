"""Secret scans that link the parts of multipart credentials, in DataFrame functions alone.

Base spans follow three patterns. Besides, a text is searched for weak parts, which alone prove nothing: access
identifiers (``id``), secrets (``secret``) and endpoints (``endpoint``). Parts are intervals of code points; two are
within one scope when at most ``SCOPE`` code points lie between them. An interval join keeps a weak part only if
complementary parts lie in its scope: an identifier needs a secret, an endpoint needs a secret, a secret needs an
identifier or an endpoint. Base spans count as parts: ``access`` as an identifier, ``assign`` and ``hex`` as secrets. A part
doesn't support itself: a weak part that overlaps a base span is that span, and a weak secret that overlaps an identifier or an
endpoint is a piece of it (the value of ``client_id=``, the path of an address).

A part's nearest neighbours of a class before and after it decide whether any lies in its scope, so the interval join is
one window over a document's parts and makes no pairs. Positions come from the lengths of matches and of what lies between
them, summed up by the same kind of window; only lengths, never texts, are shuffled.

Nulls: a null text is empty and has no spans. Repeated rows are searched each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.llm.common import cut

#: Code points between two parts of one scope at most.
SCOPE = 200

#: Base kinds in their order: pattern and least length, of group 2 for `assign`.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_ASSIGNED = 8

#: Weak parts: what names itself an identifier, a secret or an endpoint, tokens of 24 and more mixed letters and digits, and addresses.
ID = r"""(?i)(?<![A-Za-z0-9])(access_?key_?id|client_?id|app_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
SECRET = (
    r"""(?i)(?<![A-Za-z0-9])(secret_?(access_?)?key|client_?secret|private_?key|credential|auth|pwd|pass)["']?\x20*[:=]\x20*["']?[^\s"',;]{6,}"""
    r"""|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=(?-i:[A-Z0-9+/_-]*+[a-z]))(?=(?-i:[a-z0-9+/_-]*+[A-Z]))[A-Za-z0-9+/_-]{24,}+"""
)
ENDPOINT = r"""(?i)(?<![A-Za-z0-9])[a-z][a-z0-9+]{1,15}://[^\s"'<>]{3,}|(?i)(?<![A-Za-z0-9])(host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63}){1,8}(:[0-9]{2,5})?"""

#: All kinds in their order: pattern, class, whether it is weak.
KINDS = (("assign", ASSIGN, "s", False), ("access", ACCESS, "i", False), ("hex", HEX, "s", False), ("id", ID, "i", True), ("secret", SECRET, "s", True), ("endpoint", ENDPOINT, "e", True))


def _lengths(text: Column, kind: int) -> Column:
    """``struct(kind, gap, len, ok)`` of each match: the code points between it and the match before, and its own."""
    name, pattern, _, _ = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if name == "assign":
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        each = F.zip_with(F.arrays_zip(gaps.alias("g"), matches.alias("m")), value, lambda x, v: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(v) >= LEAST_ASSIGNED).alias("ok")))
    else:
        each = F.zip_with(gaps, matches, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("len"), F.lit(True).alias("ok")))
    found = F.filter(each, lambda x: x["len"].isNotNull())  # the last gap has no match after it
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """``row, doc_id, found``: every document with its matches of all kinds, as lengths."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.concat(*[_lengths(text, k) for k in range(len(KINDS))]).alias("found")).withColumn("row", F.monotonically_increasing_id())


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, kind, start, end, weak`` of all base spans and of the weak parts that complementary parts support."""
    each = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("at")
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.where("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    classes = F.element_at(F.array(*[F.lit(c) for _, _, c, _ in KINDS]), F.col("kind") + 1)
    weak = F.element_at(F.array(*[F.lit(w) for *_, w in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn("class", classes).withColumn("weak", weak)
    # Spans that end latest before a part and start first after it tell whether any overlaps it, or lies in its scope.
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    until, since = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def overlaps(which: Column) -> Column:
        end, start = F.max(F.when(which, F.col("end"))).over(until), F.min(F.when(which, F.col("start"))).over(since)
        return F.coalesce(end > F.col("start"), F.lit(False)) | F.coalesce(start < F.col("end"), F.lit(False))

    spans = spans.withColumn("drop", F.col("weak") & overlaps(~F.col("weak"))).where("not drop")
    spans = spans.withColumn("drop", F.col("weak") & (F.col("class") == "s") & overlaps(F.col("weak") & (F.col("class") != "s"))).where("not drop")

    def near(of: str) -> Column:
        last = F.max(F.when(F.col("class") == of, F.col("end"))).over(until)
        first = F.min(F.when(F.col("class") == of, F.col("start"))).over(since)
        return F.coalesce(F.col("start") - last <= scope, F.lit(False)) | F.coalesce(first - F.col("end") <= scope, F.lit(False))

    supported = F.when(F.col("class") == "s", near("i") | near("e")).otherwise(near("s"))
    return spans.withColumn("supported", supported).where("not weak or supported").select("row", "kind", "start", "end", "weak")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_linked``, the weak parts that were linked."""
    found = cut(parts(docs), "parts")
    names = F.element_at(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", names, F.col("start").cast("string"), F.col("end").cast("string")).alias("text"), "weak")
    grouped = linked(found, scope).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda x: x["text"]), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")

    base = joined(F.filter("all", lambda x: ~x["weak"]))
    digest = grouped.select(F.col("row").alias("__row"), *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(3)], F.sha2(base, 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.size(F.filter("all", lambda x: x["weak"])).cast("long").alias("n_linked"))
    out = found.select("row", "doc_id").join(digest, F.col("row") == F.col("__row"), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))
