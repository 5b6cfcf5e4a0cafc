"""Several values packed in one field.

The separators of a source are inferred, not configured.  Every punctuation
mark, tab, line break and every word that stands alone between two pieces is a
candidate; a candidate's score in a source combines

* piece type regularity: the share of its occurrences whose neighbours on both
  sides are empty, quoted, or of one of the source's common piece shapes (a
  twentieth of its pieces, smoothed towards the shape's share in the corpus), and
* piece-count consistency: ``mean(n)**2 / mean(n**2)`` of the number of pieces
  it cuts a field into,

and is smoothed towards the candidate's score over all sources, so a source of
one row is judged by what the candidate does elsewhere.  Accepted candidates
form the source's cutting expression; the field is then cut outside quotes and
round brackets and exploded with the position kept.

Everything is JVM-side, and a field is cut into pieces once.  The group-bys
combine map-side, so a source with a third of all rows is as cheap as any; what
is known of a source goes back to its rows by broadcast if it is hot.

Defined results: a null or blank field gives no row; empty pieces are dropped
and not counted; repeats stay; a quote that is never closed is an ordinary
character; columns of the input other than the three named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import skew
from ledgerloom.session import Scratch

# Word connectives accepted as candidates wherever they stand alone between pieces.
CONNECTIVES = ("und", "sowie", "u", "oder", "bzw", "and", "or", "et", "ou", "plus")

QUOTED = r"""(?:"(?:[^"]|"")*+"|'(?:[^']|'')*+'|„[^“”"]*+[“”"]|“[^”]*+”|«[^»]*+»|‚[^‘’]*+[‘’])"""
ROUND = r"(?:\((?:[^()]|\([^()]*+\))*+\))"
# Anything that is not a letter, digit, mark, blank, quote, bracket, dot, hyphen or underscore.
MARK = r"""[^\p{L}\p{N}\p{M}  ._\-()\[\]{}"'„“”«»‚‘’]"""
WORD = r"(?<=[  ])(?iu:" + "|".join(CONNECTIVES) + r")\.?(?=[  ])"
TOKEN = f"({QUOTED}|{ROUND})|({MARK}|{WORD})"
CUT, KEEP = "\u0003", "\u0004"
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def unwrap(field: Column) -> Column:
    """Trim, and remove one list wrapper that encloses the whole field."""
    text = F.regexp_replace(field, BLANKS, "")
    wrapped = text.rlike(r"(?s)^\[[^\[\]]*\]\z") | text.rlike(r"(?s)^\{[^{}]*\}\z")
    return F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def _tokens(text: Column) -> Column:
    """Alternating pieces and separators; a quoted or bracketed part is followed by the separator ''."""
    return F.split(F.regexp_replace(text, TOKEN, f"$1{CUT}$2{CUT}"), CUT)


def _sep(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"\.$", ""))


def _shape(piece: Column) -> Column:
    """Letters to A, digits to 9, runs collapsed, first word only: ``UKV-B.5 Export`` -> ``A-A.9``."""
    word = F.regexp_extract(piece, r"^[\s\p{Z}]*(\S*)", 1)
    return F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "A"), r"\p{N}+", "9")


def cut_fields(df: DataFrame, key: str, source: str, field: str) -> DataFrame:
    """key, source ('' and a mark for null), row, a: pieces and candidate separators of every field that is neither null nor blank, written once."""
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = df.select(F.col(key).alias("key"), named.alias("source"), F.monotonically_increasing_id().alias("row"), unwrap(F.col(field)).alias("t")).where(F.col("t") != "")
    return Scratch(df.sparkSession, "packed").write(rows.select("key", "source", "row", _tokens(F.col("t")).alias("a")), "cut")


def common_shapes(cut: DataFrame, smoothing: float) -> DataFrame:
    """source, shapes: the piece shapes with a twentieth of a source's pieces, smoothed by the corpus; at most some twenty each."""
    pieces = cut.select("source", F.explode(F.filter("a", lambda x, i: i % 2 == 0)).alias("p")).select("source", _shape(F.col("p")).alias("shape")).where(F.col("shape").rlike("[A9]"))
    scratch = Scratch(cut.sparkSession, "shapes")
    n = scratch.write(pieces.groupBy("source", "shape").agg(F.count("*").alias("n")), "counts")
    of_shape = n.groupBy("shape").agg(F.sum("n").alias("all_n"))
    total = n.agg(F.sum("n").alias("total"))
    of_source = n.groupBy("source").agg(F.sum("n").alias("source_n"))
    known = of_shape.crossJoin(F.broadcast(total)).where(F.col("all_n") * 20 * smoothing >= F.col("total")).select("shape", (F.col("all_n") / F.col("total")).alias("share"))
    # A source's own shapes, and the corpus's whether it has them or not (at most 400 of them are frequent enough to count).
    own = n.join(of_source, "source").join(known, "shape", "left").select("source", "shape", "n", "source_n", F.coalesce("share", F.lit(0.0)).alias("share"))
    lent = of_source.crossJoin(F.broadcast(known.where("share >= 0.05"))).select("source", "shape", F.lit(0).cast("bigint").alias("n"), "source_n", "share")
    both = scratch.write(own, "own").unionByName(scratch.write(lent, "lent"))
    g = both.groupBy("source", "shape").agg(F.max("n").alias("n"), F.max("source_n").alias("source_n"), F.max("share").alias("share"))
    common = (F.col("n") + smoothing * F.col("share")) * 20 >= F.col("source_n") + smoothing
    return scratch.write(g.where(common).groupBy("source").agg(F.collect_set("shape").alias("shapes")), "common")


def separators(cut: DataFrame, least: float = 0.4, smoothing: float = 20.0, hot: DataFrame | None = None) -> DataFrame:
    """Scores of every candidate in every source of ``cut_fields``: source, sep, uses, regularity, consistency, score, accepted."""

    def regular(p: Column) -> Column:
        bare = F.trim(p)
        return (bare == "") | bare.rlike(r"""^["'(„“«]""") | F.array_contains("shapes", _shape(p))

    shaped = skew.join_hot(cut.where(F.size("a") > 1), "source", common_shapes(cut, smoothing).withColumnRenamed("source", "s"), "s", hot).drop("s")
    shaped = shaped.withColumn("shapes", F.coalesce("shapes", F.array().cast("array<string>")))
    uses = shaped.select("source", "row", "a", "shapes", F.explode(F.sequence(F.lit(1), F.size("a") - 2, F.lit(2))).alias("i"))
    uses = uses.select("source", "row", _sep(F.element_at("a", F.col("i") + 1)).alias("sep"), (regular(F.element_at("a", F.col("i"))) & regular(F.element_at("a", F.col("i") + 2))).cast("int").alias("good")).where("sep != ''")
    # Per field first, so that a field counts once in the piece-count statistics.
    per_field = uses.groupBy("source", "row", "sep").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    stats = per_field.groupBy("source", "sep").agg(
        F.sum("n").alias("uses"), F.sum("good").alias("good"), F.count("*").alias("fields"),
        F.sum(F.col("n") + 1).alias("n1"), F.sum((F.col("n") + 1) * (F.col("n") + 1)).alias("n2"),
    )
    overall = stats.groupBy("sep").agg(*[F.sum(c).alias(f"g_{c}") for c in ("uses", "good", "fields", "n1", "n2")])
    k = F.lit(smoothing)
    regularity = (F.col("good") + k * F.col("g_good") / F.col("g_uses")) / (F.col("uses") + k)
    steady = lambda n1, n2, n: F.col(n1) * F.col(n1) / (F.col(n) * F.col(n2))
    consistency = (F.col("fields") * steady("n1", "n2", "fields") + k * steady("g_n1", "g_n2", "g_fields")) / (F.col("fields") + k)
    scored = stats.join(overall, "sep").select("source", "sep", "uses", regularity.alias("regularity"), consistency.alias("consistency"))
    return scored.withColumn("score", F.col("regularity") * (0.5 + 0.5 * F.col("consistency"))).withColumn("accepted", F.col("score") >= least)


def split_packed(df: DataFrame, key: str, source: str, field: str, least: float = 0.4) -> DataFrame:
    """One row per value: ``key``, item_no (from 1), item.

    ``A-1; "x;y" und A-2`` gives (1, A-1), (2, x;y), (3, A-2).
    """
    cut = cut_fields(df, key, source, field)
    hot = skew.hot_keys(cut, "source")
    ok = separators(cut, least, hot=hot).where("accepted").groupBy("source").agg(F.collect_set("sep").alias("ok")).withColumnRenamed("source", "s")
    joined = skew.join_hot(cut, "source", ok, "s", hot).select(F.col("key").alias(key), "a", F.coalesce("ok", F.array().cast("array<string>")).alias("ok"))
    marked = F.transform("a", lambda x, i: F.when((i % 2 == 1) & F.array_contains("ok", _sep(x)), F.lit(KEEP)).otherwise(x))
    strip = lambda x: F.regexp_replace(x, BLANKS, "")
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)

    def bare(x: Column) -> Column:
        t = strip(x)
        return strip(
            F.when(t.rlike(r'(?s)^"(?:[^"]|"")*"$'), F.replace(inner(t), F.lit('""'), F.lit('"')))
            .when(t.rlike(r"(?s)^'(?:[^']|'')*'$"), F.replace(inner(t), F.lit("''"), F.lit("'")))
            .when(t.rlike(r'(?s)^(?:„[^“”"]*[“”"]|“[^”]*”|«[^»]*»|‚[^‘’]*[‘’])$'), inner(t))
            .otherwise(t)
        )

    items = F.filter(F.transform(F.split(F.array_join(marked, ""), KEEP), bare), lambda x: x != "")
    return joined.select(key, F.posexplode(items).alias("i", "item")).select(key, (F.col("i") + 1).cast("int").alias("item_no"), "item")
