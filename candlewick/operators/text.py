"""News text: lexicon sentiment with negation, bigrams and modifiers, aggregates, trending topics, duplicates and search.

Lexicons are parameters; everything up to an aggregate is narrow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import scratch
from .names import contained

#: Words before a term that a negation reaches over, and the threshold of the labels.
REACH, THRESHOLD = 3, 0.2


@dataclass(frozen=True)
class Lexicon:
    """Words to weights; bigrams are "first second" to a signed weight, modifiers multiply the next term."""

    positive: dict[str, float] = field(default_factory=dict)
    negative: dict[str, float] = field(default_factory=dict)
    neutral: frozenset[str] = frozenset()
    negations: frozenset[str] = frozenset()
    bigrams: dict[str, float] = field(default_factory=dict)
    modifiers: dict[str, float] = field(default_factory=dict)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[\w']+\b"), F.lit(0))


def _weighed(tokens_: list[str], lex: Lexicon) -> tuple[float, float, int, list[str], list[str]]:
    """Positive and negative weight, terms, and the words of either side, of one text."""
    n = len(tokens_)
    negated = lambda i: -1.0 if any(w in lex.negations for w in tokens_[max(i - REACH, 0) : i]) else 1.0
    modifier = lambda i: lex.modifiers.get(tokens_[i], 1.0) if i >= 0 else 1.0
    pairs = [lex.bigrams.get(f"{a} {b}", 0.0) for a, b in zip(tokens_, tokens_[1:])] if lex.bigrams else [0.0] * max(n - 1, 0)
    values = [w * modifier(i - 1) * negated(i) for i, w in enumerate(pairs) if w]
    begins = [bool(w) for w in pairs] + [False]
    sides: tuple[list[str], list[str]] = ([], [])
    before = False  # whether a bigram uses the word before
    for i, word in enumerate(tokens_):
        used = begins[i] or (i > 0 and begins[i - 1])
        if not used:
            p, q = lex.positive.get(word), lex.negative.get(word)
            if p is not None or q is not None or word in lex.neutral:
                value = (p if p is not None else -abs(q) if q is not None else 0.0) * (modifier(i - 1) if i and not before else 1.0) * negated(i)
                values.append(value)
                if value:
                    sides[value < 0].append(word)
        before = used
    return sum((v for v in values if v > 0), 0.0), sum((-v for v in values if v < 0), 0.0), len(values), sides[0][:10], sides[1][:10]


def scored(df: DataFrame, text: str, lex: Lexicon, out: str = "sentiment") -> DataFrame:
    """Add a struct (score, confidence, label, positive, negative) for the text column.

    A bigram uses up its two words and may overlap another; it is negated by one of the three words before. Words that no
    bigram uses count with the modifier before them, unless that is used up; a negation swaps sides. Words are split in the JVM and looked up
    in dictionaries, batch by batch, in time that doesn't depend on the size of the lexicon.
    """

    @F.pandas_udf("p double, q double, k int, up array<string>, down array<string>")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_weighed(list(t), lex) for t in texts], columns=["p", "q", "k", "up", "down"])

    df = df.withColumn("__w", weighed(tokens(F.col(text))))
    p, q = F.col("__w.p"), F.col("__w.q")
    score = F.round(F.coalesce(F.try_divide(p - q, p + q), F.lit(0.0)), 3)
    confidence = F.round(F.least(F.log(1.0 + F.col("__w.k")) / F.log(F.lit(21.0)), F.lit(1.0)), 3)
    return df.withColumn(out, F.struct(score.alias("score"), confidence.alias("confidence"), label(score).alias("label"), F.col("__w.up").alias("positive"), F.col("__w.down").alias("negative"))).drop("__w")


def label(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")


def articles_scored(df: DataFrame, lex: Lexicon) -> DataFrame:
    """(2 * title + description) / 3 of the rounded scores, mean confidence, and up to five distinct words in order."""
    df = scored(scored(df, "title", lex, "__title"), "description", lex, "__description")
    score = F.round((2 * F.col("__title.score") + F.col("__description.score")) / 3, 3)
    words = lambda side: F.slice(F.array_sort(F.array_distinct(F.concat(F.col(f"__title.{side}"), F.col(f"__description.{side}")))), 1, 5)
    return df.withColumns({"score": score, "confidence": F.round((F.col("__title.confidence") + F.col("__description.confidence")) / 2, 3), "label": label(score), "positive_words": words("positive"), "negative_words": words("negative")}).drop("__title", "__description")


def aggregate(df: DataFrame, *keys: str, threshold: float = THRESHOLD) -> DataFrame:
    """Mean score, counts and shares of the labels, overall or for each key."""
    count = lambda name: F.count_if(F.col("label") == name)
    out = df.groupBy(*keys).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"), *[count(x).alias(f"n_{x}") for x in ("positive", "negative", "neutral")])
    out = out.withColumns({f"{x}_percent": F.try_divide(F.col(f"n_{x}") * 100.0, F.col("n")) for x in ("positive", "negative", "neutral")})
    return out.withColumn("overall", label(F.col("mean_score"), threshold))


def trending(df: DataFrame, stop: frozenset[str] = frozenset(), newest: int = 100, k: int = 10) -> DataFrame:
    """The most frequent words of more than three letters in the ``newest`` titles; ties by word."""
    recent = df.orderBy(F.col("published").desc(), "article_id").limit(newest)
    words = recent.select(F.explode(F.split(F.lower("title"), r"\s+")).alias("w")).select(F.regexp_replace("w", "[^a-z0-9]", "").alias("topic"))
    keep = words.filter(F.length("topic") > 3)
    if stop:
        keep = keep.filter(~F.col("topic").isin(*sorted(stop)))
    return keep.groupBy("topic").agg(F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "topic").limit(k)


def first_by_title(df: DataFrame) -> DataFrame:
    """The first article of each title, compared in lower case and trimmed."""
    order = Window.partitionBy(F.lower(F.trim("title"))).orderBy("article_id")
    return df.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


#: Titles with a word that meet in one place; a word of more is several blocks.
BLOCK = 1024


def similar_titles(df: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, similarity) of articles whose title words have a Jaccard similarity of ``threshold`` and more.

    Equal word sets form one class, so copies make no pairs among themselves: ``a`` and ``b`` are the first
    articles of two classes. Candidates share a word among the rarest of each title: a title of n words keeps
    n - ceil(threshold * n) + 1 of them, which any similar pair must share; it is looked at where the rarest of those it shares
    is. Titles of a word are dealt to blocks of some ``block``, and each two blocks are a group, so nothing holds all of a word or a pair twice.
    """
    spark = df.sparkSession
    path = scratch(spark, "titles")
    sets = df.select("article_id", F.array_sort(word_set(F.col("title"))).alias("words")).filter(F.size("words") > 0)
    sets.groupBy("words").agg(F.min("article_id").alias("id")).write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    exploded = classes.select("id", F.explode("words").alias("w"))
    exploded.groupBy("w").agg(F.count("*").alias("df")).write.parquet(f"{path}/rarity")
    rarity = spark.read.parquet(f"{path}/rarity")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows are few and what comes of them is much, so tasks aren't put together
    common = rarity.filter(F.col("df") > classes.count() / 1000).withColumnRenamed("df", "often")  # of which a title's words allow few
    told = exploded.join(F.broadcast(common), "w", "left")
    rare = told.filter("often IS NULL").select("id", "w").repartition(parts, "w").join(rarity, "w")
    every = rare.select("id", "df", "w").unionByName(told.filter("often IS NOT NULL").select("id", F.col("often").alias("df"), "w"))
    ranked = every.repartition(parts, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ranked"))
    size = F.size("ranked")
    first = F.slice("ranked", 1, (size - F.ceil(size * threshold) + 1).cast("int"))
    ranked.select("id", F.col("ranked.w").alias("words"), first.alias("first")).write.parquet(f"{path}/ranked")
    places = spark.read.parquet(f"{path}/ranked").select("id", "words", F.col("first.w").alias("first"), F.explode("first").alias("p"))
    places = places.filter("p.df > 1").select("id", "words", "first", F.col("p.w").alias("w"))  # no other title has a word of one
    blocks = places.groupBy("w").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = places.join(blocks, "w").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = dealt.select("w", F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"), F.struct("id", "words", "first").alias("x")).repartition(parts, "w", "low", "high")
    y = dealt.select("w", F.explode(F.sequence(F.lit(0), "own")).alias("low"), F.col("own").alias("high"), F.struct("id", "words", "first").alias("y")).repartition(parts, "w", "low", "high")
    sizes = F.size("x.words"), F.size("y.words")
    met = x.join(y, ["w", "low", "high"]).filter((F.col("low") < F.col("high")) | (F.col("x.id") < F.col("y.id"))).filter(F.least(*sizes) >= F.greatest(*sizes) * threshold - 1e-6)
    both = met.filter(F.get(F.array_intersect("x.first", "y.first"), F.lit(0)) == F.col("w"))
    pairs = both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), jaccard(F.col("x.words"), F.col("y.words")).alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def keep_first(df: DataFrame, group: str, threshold: float = 0.8) -> DataFrame:
    """Within each group (the results of one query), keep an article unless a kept one before it has its url or a similar title."""
    rows = F.array_sort(F.collect_list(F.struct("article_id", "url", word_set(F.col("title")).alias("words"))))
    empty = F.array().cast("array<struct<article_id:bigint,url:string,words:array<string>>>")
    again = lambda kept, x: F.exists(kept, lambda y: (y["url"] == x["url"]) | (jaccard(y["words"], x["words"]) >= threshold))
    kept = F.aggregate("rows", empty, lambda a, x: F.when(F.coalesce(again(a, x), F.lit(False)), a).otherwise(F.array_append(a, x)))
    return df.groupBy(group).agg(rows.alias("rows")).select(group, F.explode(kept).alias("k")).select(group, "k.article_id")


def keep_first_in_rounds(df: DataFrame, group: str, threshold: float = 0.8, most_rounds: int = 1000) -> DataFrame:
    """``keep_first`` of groups of any size: (group, article_id) of the first independent set of the articles in their order, found in rounds.

    An article waits for the earlier ones that have its url, its word set or a similar one. In each round it is kept if none of these is left undecided or kept, and goes if one
    is kept. What a url or word set has to say is its earliest article that hasn't gone, so copies make no pairs; word sets meet by their rarest words, as in ``similar_titles``.
    """
    spark = df.sparkSession
    path = scratch(spark, "first")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    words = F.array_sort(word_set(F.coalesce("title", F.lit(""))))
    rows = kept(df.select(F.col(group).alias("g"), "article_id", "url", words.alias("words")).withColumn("w", F.when(F.size("words") > 0, F.sha2(F.concat_ws("\n", "words"), 256))), "rows")
    sets = kept(rows.filter("w IS NOT NULL").groupBy("g", "w").agg(F.first("words").alias("words")), "sets")
    each = sets.select("g", "w", F.explode("words").alias("word"))
    rare = each.groupBy("g", "word").agg(F.count("*").alias("n"))
    ranked = each.join(rare, ["g", "word"]).groupBy("g", "w").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    prefix = ranked.select("g", "w", F.explode(F.slice("r", 1, (F.size("r") - F.ceil(F.size("r") * threshold) + 1).cast("int"))).alias("p")).select("g", "w", F.col("p.word").alias("word"))
    pairs = prefix.join(prefix.withColumnRenamed("w", "near"), ["g", "word"]).filter("w < near").select("g", "w", "near").distinct()
    pairs = pairs.join(sets.withColumnRenamed("words", "a"), ["g", "w"]).join(sets.select("g", F.col("w").alias("near"), F.col("words").alias("b")), ["g", "near"]).filter(jaccard(F.col("a"), F.col("b")) >= threshold)
    pairs = pairs.select("g", "w", "near")
    near = kept(pairs.unionByName(pairs.select("g", F.col("near").alias("w"), F.col("w").alias("near"))).unionByName(sets.select("g", "w", F.col("w").alias("near"))), "near")
    state = kept(rows.select("g", "article_id", "url", "w", F.lit(None).cast("boolean").alias("stays")), "state-0")  # None: undecided
    for k in range(1, most_rounds + 1):
        left = state.filter("stays OR stays IS NULL")
        first = F.min(F.struct("article_id", F.coalesce("stays", F.lit(False)).alias("stays")))
        by_url = left.filter("url IS NOT NULL").groupBy("g", "url").agg(first.alias("u"))
        by_set = left.filter("w IS NOT NULL").groupBy("g", F.col("w").alias("near")).agg(first.alias("f"))
        heads = near.join(by_set, ["g", "near"]).groupBy("g", "w").agg(F.collect_list("f").alias("heads"))
        open_ = state.filter("stays IS NULL").join(by_url, ["g", "url"], "left").join(heads, ["g", "w"], "left")
        said = F.filter(F.concat(F.coalesce("heads", F.array()), F.when(F.col("u").isNotNull(), F.array("u")).otherwise(F.array())), lambda f: f["article_id"] < F.col("article_id"))
        verdict = F.when(F.exists(said, lambda f: f["stays"]), F.lit(False)).when(F.size(said) == 0, F.lit(True))
        state = kept(state.filter("stays IS NOT NULL").unionByName(open_.select("g", "article_id", "url", "w", verdict.alias("stays"))), f"state-{k}")
        if state.filter("stays IS NULL").isEmpty():
            return state.filter("stays").select(F.col("g").alias(group), "article_id")
    raise RuntimeError("articles were left undecided")


def search(df: DataFrame, query: str, since: Column, limit: int = 20, newest: int = 100) -> DataFrame:
    """The ``newest`` articles first, then those that contain the query, then the date filter and the limit: the order of these steps counts."""
    recent = df.orderBy(F.col("published").desc(), "article_id").limit(newest)
    found = F.contains(F.lower(F.concat_ws(" ", "title", "description")), F.lit(query.lower()))
    return recent.filter(found & (F.col("published") >= since)).orderBy(F.col("published").desc(), "article_id").limit(limit)


def _clean(symbol: Column) -> Column:
    """A symbol in lower case without its exchange."""
    return F.lower(F.regexp_replace(F.upper(symbol), r"\.(NS|BO)$", ""))


def _naming(df: DataFrame, asked: DataFrame) -> DataFrame:
    """``df`` with the other columns of each row of ``asked`` (name, ...) whose name an article has in title or description; articles have an article_id each."""
    text = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("\n"), F.lower(F.coalesce("description", F.lit(""))))
    found = contained(df.select("article_id", text.alias("__text")), "article_id", "__text", asked)
    return df.join(found.join(asked, "name").drop("name").distinct(), "article_id")


def for_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Articles whose title or description contains a symbol, without its exchange suffix, or its alias, in any case; one row for each article and symbol.

    ``symbols`` is (symbol), and alias for a company's name where there is one; it may be long. Symbols that are empty without their suffix, and empty
    aliases, are in no article.
    """
    alias = F.lower("alias") if "alias" in symbols.columns else F.lit(None).cast("string")
    asked = symbols.select("symbol", F.explode(F.array_compact(F.array(_clean(F.col("symbol")), alias))).alias("name"))
    return _naming(df, asked)


def stock_news(df: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """The newest ``limit`` articles of each symbol that name its company; for symbols without any, those that name the symbol itself.

    Listings that share a company share its articles, each once.
    """
    tiers = F.array(F.struct(F.lit(0).alias("broad"), _clean(F.coalesce("alias", "symbol")).alias("name")), F.struct(F.lit(1).alias("broad"), _clean(F.col("symbol")).alias("name")))
    asked = symbols.select("symbol", F.explode(tiers).alias("t")).select("symbol", F.col("t.name").alias("name"), F.col("t.broad").alias("__broad")).groupBy("symbol", "name").agg(F.min("__broad").alias("__broad"))
    rows = _naming(df, asked)
    least = rows.groupBy("symbol").agg(F.min("__broad").alias("__broad"))
    kept = rows.join(least, ["symbol", "__broad"]).drop("__broad")
    order = Window.partitionBy("symbol").orderBy(F.col("published").desc(), "article_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def feed(df: DataFrame, now: Column, most: int = 20, days: int = 30) -> DataFrame:
    """Up to ``most`` entries of each source in feed order, none older than ``days``; entries without a date count as now."""
    dated = df.withColumn("published", F.coalesce("published", now))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("position"))
    return dated.withColumn("__r", rank).filter((F.col("__r") <= most) & (F.col("published") >= now - F.make_dt_interval(F.lit(days)))).drop("__r")


def known_date(text: Column, now: Column) -> Column:
    """ISO or common news formats, "3 hours ago", else null."""
    amount = F.regexp_extract(F.lower(text), r"(\d+)\s*(minute|hour|day|week|month)s?\s+ago", 1)
    unit = F.regexp_extract(F.lower(text), r"(\d+)\s*(minute|hour|day|week|month)s?\s+ago", 2)
    minutes = F.create_map(*[F.lit(x) for kv in {"minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200}.items() for x in kv])[unit]
    relative = F.when(amount != "", now - F.make_dt_interval(F.lit(0), F.lit(0), (F.try_to_number(amount, F.lit("999999")).cast("int") * minutes).cast("int")))
    formats = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[X]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy")]
    return F.coalesce(*formats, relative)


def parsed_date(text: Column, now: Column) -> Column:
    """ISO or common news formats, "3 hours ago", else now."""
    return F.coalesce(known_date(text, now), now)


def web_results(results: DataFrame, attempts: DataFrame, now: Column, days: int = 7, most: int = 10) -> DataFrame:
    """What a web search gives for each query: the first ``most`` results of the first provider that answered it, without those dated before the last ``days``; undated ones stay.

    ``results`` is (query, provider, position, date, ...) with dates as text, ``attempts`` (query, provider, priority, answered).
    """
    order = F.when(F.col("answered"), F.struct("priority", "provider"))
    used = attempts.groupBy("query").agg(F.min(order).alias("__used")).select("query", F.col("__used.provider").alias("provider")).filter("provider IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query", "provider").orderBy("position"))
    rows = results.join(used, ["query", "provider"], "left_semi").withColumns({"rank": rank, "published": known_date(F.col("date"), now)}).filter(F.col("rank") <= most)
    return rows.filter(F.col("published").isNull() | (F.col("published") >= now - F.make_dt_interval(F.lit(days))))
