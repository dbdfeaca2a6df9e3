"""References and ranked suggestions for whole tables of typed texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegraph.functions import text
from placegraph.operators.common import top_k

#: Longest text whose answers are ranked beforehand, and the length of the pieces that longer ones are looked up by.
GRAM = 3


def _pieces(x: Column, least: int, most: int = GRAM) -> Column:
    """Every distinct piece of ``least`` to ``most`` characters."""
    n = F.length(x)
    piece = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substr(x, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[piece(k) for k in range(least, most + 1)]))


def _containing(texts: DataFrame, said: str, entries: DataFrame, value: str) -> DataFrame:
    """Texts with the entries whose ``value`` contains them, for texts longer than ``GRAM``.

    A text is looked up by its rarest piece alone: how many entries hold each piece is
    counted first, and a text with a piece that no entry holds meets none.
    """
    index = entries.withColumn("_g", F.explode(_pieces(F.col(value), GRAM)))
    held = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    long = texts.where(F.length(said) > GRAM)
    asked = long.select(said).distinct().withColumn("_g", F.explode(_pieces(F.col(said), GRAM))).join(held, "_g", "left")
    rarest = asked.groupBy(said).agg(F.min_by("_g", "_df").alias("_g"), F.count_if(F.col("_df").isNull()).alias("_none")).where("_none = 0").drop("_none")
    return long.join(rarest, said).join(index, "_g").where(F.contains(value, F.col(said))).drop("_g")


def _short(texts: DataFrame, said: str, entries: DataFrame, values: Sequence[str], score: Callable[[Column], Column], order: Sequence[Column], k: int) -> DataFrame:
    """Best ``k`` entries of every text of at most ``GRAM`` characters: ranked for each piece before any text is met."""
    every = F.array_distinct(F.concat(*[_pieces(F.col(v), 1) for v in values]))
    ranked = top_k(entries.withColumn("_g", F.explode(every)).withColumn("score", score(F.col("_g"))), ["_g"], order, k)
    return texts.where(F.length(said) <= GRAM).join(ranked.withColumnRenamed("_g", said), said)


def suggest(queries: DataFrame, rooms: DataFrame, places: DataFrame, k: int = 8) -> DataFrame:
    """Best k rooms and buildings per typed text.

    Nothing is cut before ranking. Texts of up to three characters find answers that
    are ranked beforehand; longer ones meet the entries that share their rarest piece
    of three characters, then the exact rule decides. Equal texts are answered once.
    ``places``: ``name, display, kind``, one row per name. Returns ``query_id, rank, score, label, building, room``.
    """
    words = F.upper(F.trim("text"))
    asked = queries.select("query_id", words.alias("words"), F.regexp_replace(words, r"\s+", "").alias("q")).where("q <> ''")
    texts = asked.select("words", "q").distinct()
    r = rooms.where(text.is_destination("type") & text.filled("building") & text.filled("room")).select(
        "building", "room", "label", F.upper(F.concat_ws("-", "building", "room")).alias("ul"), F.upper("room").alias("ur"), F.upper(F.coalesce("name", F.lit(""))).alias("un"))
    score = lambda q, w: (F.when((F.col("ur") == q) | (F.col("ul") == q), 0.0).when(F.startswith("ur", q), 1.0)
                          .when(F.startswith("ul", q) | ((F.col("un") != "") & F.startswith("un", w)), 2.0).otherwise(3.0))
    order = [F.col("score"), text.natural_key("room"), F.col("label")]
    # A short text without a space inside is one of the pieces; with one, its two forms differ and it goes the long way.
    plain = texts.where(F.col("q") == F.col("words"))
    spaced = texts.where((F.col("q") != F.col("words")) & (F.length("q") <= GRAM))
    short = _short(plain, "q", r, ["ul", "un"], lambda g: score(g, g), order, k).select("words", "score", "label", "building", "room")
    by_code = _containing(texts, "q", r, "ul").unionByName(
        spaced.join(r.withColumn("q", F.explode(_pieces(F.col("ul"), 1))), "q").select("words", "q", *r.columns))
    by_name = _containing(texts.where((F.length("q") > GRAM) | (F.col("q") != F.col("words"))), "words", r.where("un <> ''"), "un").unionByName(
        spaced.where(F.length("words") <= GRAM).join(r.withColumn("words", F.explode(_pieces(F.col("un"), 1))), "words").select("words", "q", *r.columns))
    by_name = by_name.where(~F.contains("ul", F.col("q")))
    long = by_code.unionByName(by_name).select("words", score(F.col("q"), F.col("words")).alias("score"), "label", "building", "room")
    b = places.select(F.col("name").alias("building"), F.upper("name").alias("ul")).distinct()
    starts = b.withColumn("q", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("ul"), F.lit(1))), lambda n: F.substr(F.col("ul"), F.lit(1), n))))
    code_hits = texts.join(starts, "q").select(
        "words", F.when(F.col("ul") == F.col("q"), -1.0).otherwise(1.5).alias("score"), F.col("building").alias("label"), "building", F.lit("").alias("room"))
    best = top_k(short.unionByName(long).unionByName(code_hits), ["words"], order, k)
    return asked.join(best, "words").select("query_id", "rank", "score", "label", "building", "room")


def suggest_sections(queries: DataFrame, rooms: DataFrame, places: DataFrame, per_section: int = 6) -> DataFrame:
    """Buildings (starts before contains, then title) and rooms (file order), a few of each per text."""
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''")
    texts = asked.select("q").distinct()
    b = places.select(F.col("name").alias("code"), F.coalesce(text.blank_to_null("display"), "name").alias("title"))
    b = b.withColumn("lc", F.lower("code")).withColumn("lt", F.lower("title"))
    score = lambda q: F.when(F.startswith("lc", q) | F.startswith("lt", q), 0).otherwise(1)
    order_b = [F.col("score"), F.col("title"), F.col("code")]
    short_b = _short(texts, "q", b, ["lc", "lt"], score, order_b, per_section).select("q", "score", "title", "code")
    long_b = _containing(texts, "q", b, "lc").unionByName(_containing(texts, "q", b, "lt").where(~F.contains("lc", F.col("q")))).select(
        "q", score(F.col("q")).alias("score"), "title", "code")
    top_b = top_k(short_b.unionByName(long_b), ["q"], order_b, per_section).select("q", F.lit("Buildings").alias("section"), "rank", "title")
    r = rooms.withColumn("ll", F.lower("label")).select("label", "ll", "source", "ord")
    order_r = [F.col("source"), F.col("ord")]
    short_r = _short(texts, "q", r, ["ll"], lambda g: F.lit(0), order_r, per_section).select("q", "source", "ord", "label")
    top_r = top_k(short_r.unionByName(_containing(texts, "q", r, "ll").select("q", "source", "ord", "label")), ["q"], order_r, per_section).select(
        "q", F.lit("Rooms").alias("section"), "rank", F.col("label").alias("title"))
    return asked.join(top_b.unionByName(top_r), "q").select("query_id", "section", "rank", "title")


def parse_refs(texts: DataFrame, codes: DataFrame, names: DataFrame, column: str = "text") -> DataFrame:
    """What a typed text refers to: ``building, room, ambiguous`` added.

    Tried in order: a known place as a whole, a room name (only when one room
    has it), a known code and a room, a code-like word and something with a
    digit, otherwise a bare room.
    """
    s = F.upper(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"\s+", " "))
    form = r"^([A-Z]+\d*)[-\s]+(\S.*)$"
    t = texts.withColumn("_s", s).withColumn("_head", F.nullif(F.regexp_extract(s, form, 1), F.lit(""))).withColumn("_rest", F.trim(F.regexp_extract(s, form, 2)))
    known = codes.select(F.upper("code").alias("_s")).distinct().withColumn("_whole", F.lit(True))
    heads = codes.select(F.upper("code").alias("_head")).distinct().withColumn("_known", F.lit(True))
    n = names.select(F.col("name").alias("_s"), F.col("rooms").alias("_n"), F.col("building").alias("_nb"), F.col("room").alias("_nr"))
    j = t.join(known, "_s", "left").join(n, "_s", "left").join(heads, "_head", "left")
    ref = lambda b, r, a: F.struct(b.alias("building"), r.alias("room"), F.lit(a).alias("ambiguous"))
    none = F.lit(None).cast("string")
    pick = (F.when(F.col("_s") == "", ref(none, none, False)).when(F.col("_whole"), ref(F.col("_s"), F.lit(""), False))
            .when(F.col("_n") == 1, ref(F.col("_nb"), F.col("_nr"), False)).when(F.col("_n") > 1, ref(none, F.col("_s"), True))
            .when(F.col("_head").isNotNull() & (F.coalesce("_known", F.lit(False)) | F.col("_rest").rlike(r"\d")), ref(F.col("_head"), F.col("_rest"), False))
            .otherwise(ref(none, F.col("_s"), False)))
    return j.withColumn("_p", pick).select(*texts.columns, "_p.building", "_p.room", "_p.ambiguous")


def direction_ends(asks: DataFrame, codes: DataFrame, names: DataFrame) -> DataFrame:
    """Typed From and To of a directions form as route references.

    ``asks``: ``query_id, from_text, to_text``; ``codes``: ``code, kind``. A bare
    room takes its building from the other end, never from a car park. ``status``
    is ok, no_goal, ambiguous, needs_building or from_here (no start given).
    """
    f = parse_refs(asks.select("query_id", "from_text", "to_text"), codes, names, "from_text").select(
        "query_id", "to_text", F.col("building").alias("fb"), F.col("room").alias("fr"), F.col("ambiguous").alias("fa"))
    p = parse_refs(f, codes, names, "to_text").withColumnsRenamed({"building": "tb", "room": "tr", "ambiguous": "ta"})
    lots = codes.where("kind = 'parking'").select(F.upper("code").alias("c")).distinct()
    p = p.join(lots.select(F.col("c").alias("fb"), F.lit(True).alias("flot")), "fb", "left").join(
        lots.select(F.col("c").alias("tb"), F.lit(True).alias("tlot")), "tb", "left")
    fallback = F.coalesce(F.when(F.col("flot").isNull(), F.col("fb")), F.when(F.col("tlot").isNull(), F.col("tb")), F.lit(""))
    p = p.withColumn("fallback", fallback)

    def end(b, r):
        place = F.coalesce(F.col(b), F.col("fallback"))
        whole = F.when(F.col(r) == "", F.col(b))
        return F.when(F.col(r) == "", whole).when(place != "", F.concat_ws("-", place, F.col(r))).otherwise(F.col(r))

    empty_to, empty_from = F.col("tr").isNull() & F.col("tb").isNull(), F.col("fr").isNull() & F.col("fb").isNull()
    status = (F.when(empty_to, "no_goal").when(F.col("fa") | F.col("ta"), "ambiguous")
              .when((F.col("fallback") == "") & ((~empty_from & F.col("fb").isNull()) | F.col("tb").isNull()), "needs_building")
              .when(empty_from, "from_here").otherwise("ok"))
    return p.select("query_id", end("fb", "fr").alias("start_ref"), end("tb", "tr").alias("goal_ref"), "fallback", status.alias("status"))


def find_buildings(queries: DataFrame, buildings: DataFrame, aliases: list[str]) -> DataFrame:
    """Buildings answering to a text by any of their names; the first in file order."""
    alias = buildings.select("ord", F.col("code").alias("found"), F.explode(F.array(*[F.upper(text.blank_to_null(a)) for a in aliases])).alias("alias")).where("alias IS NOT NULL")
    alias = alias.groupBy("alias").agg(F.min(F.struct("ord", "found")).alias("m"))
    return queries.withColumn("alias", F.upper(F.trim("text"))).join(alias, "alias", "left").select(*queries.columns, F.col("m.found").alias("building"))
