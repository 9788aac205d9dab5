"""Further queries over the driver's tables and their SQL: quotes' age, listings, feeds, news of symbols, caches, texts and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.shared import scratch
from .functions.windows import highest, mean
from .operators import alerts, market, patterns, scoring, text, track, wording
from .queries import _ALERTS, _ARTICLES, BARS, LEXICON, _alerts, _pattern_sql, articles, avg, full, query, rounded, table
from .sources import bars as src
from .sources import files


def _now(when: str):
    return F.lit(when).cast("timestamp_ntz")


@query("""SELECT symbol, event_id, trunc(date_diff('second', ts - INTERVAL 330 MINUTE, TIMESTAMP '2024-01-30 18:00:00') / 60.0)::BIGINT AS data_age_minutes, symbol <> 'error' AND trunc(date_diff('second', ts - INTERVAL 330 MINUTE, TIMESTAMP '2024-01-30 18:00:00') / 60.0) < 5 AS is_realtime
  FROM (SELECT event_type AS symbol, * FROM events)""")
def quotes_with_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "ts")
    return src.with_age(q, F.lit("2024-01-30 18:00:00").cast("timestamp"), intraday=F.col("symbol") != "error").drop("ts")


@query(f"""WITH {BARS.replace("l_returnflag || l_linestatus", "l_suppkey::VARCHAR")} SELECT symbol, bar_ts, round({avg('close', 20)}, 4) AS sma_20, round({full('high', 14, 'max(high)')}, 4) AS high_14 FROM bars""")
def indicators_of_many_symbols(spark, sf_dir):
    """One symbol for each supplier: many short series in place of a few long ones."""
    bars = src.daily_bars(spark, sf_dir, F.col("l_suppkey").cast("string"))
    return rounded(bars.withColumns({"sma_20": mean("close", 20), "high_14": highest("high", 14)}), "symbol", "bar_ts", "sma_20", "high_14")


@query("""WITH asked AS (SELECT c_name AS symbol FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'nobody'), facts AS (SELECT c_name AS symbol, 'Company ' || n_name AS name, nullif(c_mktsegment, 'MACHINERY') AS sector FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT symbol, name, coalesce(sector, 'N/A') AS sector FROM asked LEFT JOIN facts USING (symbol)""")
def company_facts(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    facts = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("symbol"), F.concat(F.lit("Company "), "n_name").alias("name"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("sector"))
    asked = c.filter("c_custkey % 10 = 0").select(F.col("c_name").alias("symbol")).unionByName(spark.createDataFrame([("nobody",)], "symbol string"))
    return market.company_info(facts, asked)


@query("""WITH l AS (SELECT p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN 'NSE' ELSE p_type END AS exchange, 'S' || p_partkey AS symbol, p_retailprice AS price, (p_size % 10 - 5)::DOUBLE AS change_percent FROM part)
  SELECT name, exchange, symbol, round(price - price * change_percent / 100, 4) AS previous_close FROM l QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN exchange = 'NSE' THEN 0 ELSE 1 END, exchange, symbol) = 1""")
def preferred_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "NSE").otherwise(F.col("p_type")).alias("exchange"), F.concat(F.lit("S"), "p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 10 - 5).cast("double").alias("change_percent"))
    return rounded(market.prefer_listing(rows), "name", "exchange", "symbol", "previous_close")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-03-02' ELSE TIMESTAMP '2024-03-01' - to_hours(doc_id * 5) END AS published, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
  SELECT doc_id, source, published FROM d WHERE r <= 20 AND published >= TIMESTAMP '2024-03-02' - INTERVAL 30 DAY""")
def news_feeds(spark, sf_dir):
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") * 5).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 7 != 0, _now("2024-03-01") - hours).alias("published"))
    return text.feed(d, _now("2024-03-02")).select("doc_id", "source", "published")


_ASKED = [("QU.NS", None), ("ZZQ.BO", "of the"), ("nowhere", None), ("LA", "no such name")]
_NAMED = "contains(lower(coalesce(title, '')) || chr(10) || lower(coalesce(description, '')), x)"


@query(f"WITH {_ARTICLES} SELECT article_id, symbol FROM art, (VALUES ('QU.NS', 'qu', NULL), ('ZZQ.BO', 'zzq', 'of the'), ('nowhere', 'nowhere', NULL), ('LA', 'la', 'no such name')) v(symbol, clean, alias) WHERE {_NAMED.replace(', x)', ', clean)')} OR {_NAMED.replace(', x)', ', alias)')}")
def news_of_symbols(spark, sf_dir):
    return text.for_symbols(articles(spark, sf_dir), spark.createDataFrame(_ASKED, "symbol string, alias string")).select("article_id", "symbol")


@query(f"""WITH {_ARTICLES}, v(symbol, clean, n) AS (VALUES ('QU.NS', 'qu', 'qu'), ('ZZQ.BO', 'zzq', 'of the'), ('nowhere', 'nowhere', 'nowhere'), ('LA', 'la', 'no such name')),
  h AS (SELECT symbol, article_id, published, 0 AS broad FROM art, v WHERE {_NAMED.replace(', x)', ', n)')} UNION ALL SELECT symbol, article_id, published, 1 FROM art, v WHERE {_NAMED.replace(', x)', ', clean)')}),
  k AS (SELECT * FROM h QUALIFY broad = min(broad) OVER (PARTITION BY symbol)) SELECT symbol, article_id FROM k QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC, article_id) <= 10""")
def stock_news(spark, sf_dir):
    return text.stock_news(articles(spark, sf_dir), spark.createDataFrame(_ASKED, "symbol string, alias string")).select("symbol", "article_id")


_KINDS = {"click": "stock_quote", "purchase": "market_news", "search": "fii_dii", "view": "sentiment"}
_CACHE = "c AS (SELECT CASE event_type WHEN 'click' THEN 'stock_quote' WHEN 'purchase' THEN 'market_news' WHEN 'search' THEN 'fii_dii' WHEN 'view' THEN 'sentiment' ELSE 'other' END AS kind, 'k_' || user_id AS key, ts + to_microseconds(event_id % 1000) AS cached_at, value FROM events)"


def _cached(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    fine = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("event_id") % 1000) / 1e6).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(F.coalesce(kinds[F.col("event_type")], F.lit("other")).alias("kind"), F.concat(F.lit("k_"), "user_id").alias("key"), (F.col("ts") + fine).alias("cached_at"), "value")


@query(f"""WITH {_CACHE}, l AS (SELECT *, 1000 * CASE kind WHEN 'stock_quote' THEN 60 WHEN 'fii_dii' THEN 1800 WHEN 'other' THEN 0.3 ELSE 300 END::INT AS ttl FROM c),
  k AS (SELECT * FROM l WHERE cached_at <= TIMESTAMP '2024-01-20 12:00:00' AND cached_at + to_seconds(CASE WHEN kind = 'other' THEN 300 ELSE ttl END) > TIMESTAMP '2024-01-20 12:00:00' AND NOT key LIKE 'k\\_1%' ESCAPE '\\')
  SELECT kind, key, value FROM k QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY cached_at DESC) = 1""")
def cached_answers(spark, sf_dir):
    """Live answers after some keys are cleared; lifetimes are a thousand times the usual, since events are rare."""
    ttl = {k: 1000 * v for k, v in track.TTL.items()}
    return track.live(track.cleared(_cached(spark, sf_dir), "k_1*"), _now("2024-01-20 12:00:00"), ttl=ttl).select("kind", "key", "value")


@query("""WITH s AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id)), n AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-30 12:00:00' AS ts, -1.0 AS value FROM events WHERE user_id % 2 = 0)
  SELECT s.user_id, s.ts, s.value FROM s LEFT JOIN n USING (user_id) WHERE NOT (r = 1 AND coalesce(s.ts >= n.ts - INTERVAL 1 DAY, false)) UNION ALL SELECT * FROM n""")
def rows_refreshed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.groupBy("user_id", "ts").agg(F.min_by("value", "event_id").alias("value"))
    new = e.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", _now("2024-01-30 12:00:00").alias("ts"), F.lit(-1.0).alias("value"))
    return track.refreshed(stored, new, "user_id", "ts", 1440)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'none') AS segment, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, 0.0) AS balance, CASE WHEN length(c_name) > 12 THEN true ELSE c_name = '****' END AS hidden FROM customer")
def defaults_filled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"), scoring.masked("c_name").alias("m"))
    return scoring.with_defaults(c, {"segment": "none", "balance": 0.0}).withColumn("hidden", scoring.is_masked("m")).drop("m")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 101 >= 85 THEN 'very_high' WHEN o_custkey % 101 >= 70 THEN 'high' WHEN o_custkey % 101 >= 55 THEN 'medium' WHEN o_custkey % 101 >= 40 THEN 'low' ELSE 'very_low' END AS band FROM orders")
def confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.confidence_band(F.col("o_custkey") % 101).alias("band"))


@query(f"""WITH {_ALERTS} SELECT alert_id, CASE condition WHEN 'ABOVE' THEN '📊 ' || symbol || ' is now above ₹' || target_price WHEN 'BELOW' THEN '📊 ' || symbol || ' is now below ₹' || target_price WHEN 'CROSSES_ABOVE' THEN '📈 ' || symbol || ' crossed above ₹' || target_price WHEN 'CROSSES_BELOW' THEN '📉 ' || symbol || ' crossed below ₹' || target_price
  WHEN 'PERCENT_CHANGE_UP' THEN '🚀 ' || symbol || ' gained ' || percent_change || '%! Current price: ₹' || target_price ELSE '📉 ' || symbol || ' dropped ' || coalesce(abs(percent_change)::VARCHAR, '0') || '%! Current price: ₹' || target_price END AS message FROM a""")
def alert_messages(spark, sf_dir):
    return _alerts(spark, sf_dir).select("alert_id", alerts.message().alias("message"))


@query(f"WITH {_ALERTS} SELECT alert_id FROM a WHERE status = 'active' AND symbol = 'view'")
def alerts_of_user(spark, sf_dir):
    return alerts.listed(_alerts(spark, sf_dir).withColumn("user_id", F.col("symbol")), "view", "active").select("alert_id")


@query(f"""WITH {_pattern_sql()}, t_(pattern, type, description, signal) AS (VALUES ('doji', 'indecision', 'Market indecision with small body and equal shadows', '⚠️ Wait for confirmation'), ('hammer', 'bullish_reversal', 'Bullish reversal with long lower shadow', '📈 Potential upside'), ('inverted_hammer', 'bullish_reversal', 'Bullish reversal with long upper shadow', '📈 Potential upside'),
  ('hanging_man', 'bearish_reversal', 'Bearish reversal with long lower shadow', '📉 Potential downside'), ('shooting_star', 'bearish_reversal', 'Bearish reversal with long upper shadow', '📉 Potential downside'), ('spinning_top', 'indecision', 'Indecision with small body and long shadows', '⚠️ Wait for confirmation'),
  ('bullish_engulfing', 'bullish_reversal', 'Strong bullish reversal - current candle engulfs previous', '🚀 Strong buy signal'), ('bearish_engulfing', 'bearish_reversal', 'Strong bearish reversal - current candle engulfs previous', '🔻 Strong sell signal'), ('piercing_line', 'bullish_reversal', 'Bullish reversal - closes above midpoint of previous candle', '📈 Bullish reversal'),
  ('dark_cloud_cover', 'bearish_reversal', 'Bearish reversal - closes below midpoint of previous candle', '📉 Bearish reversal'), ('morning_star', 'bullish_reversal', 'Strong bullish reversal - three candle pattern', '🚀 Strong buy signal'), ('evening_star', 'bearish_reversal', 'Strong bearish reversal - three candle pattern', '🔻 Strong sell signal'),
  ('three_white_soldiers', 'bullish_reversal', 'Strong bullish continuation - three consecutive bullish candles', '🚀 Strong bullish momentum'), ('three_black_crows', 'bearish_reversal', 'Strong bearish continuation - three consecutive bearish candles', '🔻 Strong bearish momentum'), ('harami', 'indecision', 'Indecision - small candle within previous candle''s body', '⚠️ Trend weakening'),
  ('rising_three_methods', 'bullish_continuation', 'Bullish continuation pattern', '📈 Bullish continuation'), ('falling_three_methods', 'bearish_continuation', 'Bearish continuation pattern', '📉 Bearish continuation'))
  SELECT symbol, pattern, type, description, signal, CASE direction WHEN 'indecision' THEN 'neutral' ELSE direction END AS implied, strftime(bar_ts, '%d/%m/%Y') AS date, '15:30:00' AS time, array_to_string(list_transform(string_split(pattern, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS name, '₹' || format('{{:,.2f}}', close) AS price_text FROM events JOIN t_ USING (pattern)""")
def pattern_details(spark, sf_dir):
    rows = patterns.formatted(patterns.described(patterns.detected(src.daily_bars(spark, sf_dir))))
    return rows.select("symbol", "pattern", "type", "description", F.col("implication.signal").alias("signal"), F.col("implication.direction").alias("implied"), "date", "time", "name", "price_text")


@query(f"""WITH {BARS}, wk AS (SELECT symbol, CAST(date_trunc('week', bar_ts) AS DATE) + 6 AS bar_ts, last(close ORDER BY bar_ts) AS close FROM bars GROUP BY 1, 2), h4 AS (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2000-01-01') AS bar_ts, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)
  SELECT symbol, bar_ts::TIMESTAMP AS bar_ts, round({avg('close', 10)}, 4) AS short, round({avg('close', 20)}, 4) AS long FROM wk UNION ALL SELECT symbol, bar_ts, round({avg('close', 5)}, 4), round({avg('close', 13)}, 4) FROM h4""")
def chart_overlays(spark, sf_dir):
    week = market.overlays(src.weekly(src.daily_bars(spark, sf_dir)).withColumnRenamed("bucket", "bar_ts"), 10, 20)
    four = market.overlays(src.four_hourly(src.ticks(spark, sf_dir)).withColumnRenamed("bucket", "bar_ts"), 5, 13)
    one = lambda df, a, b: df.select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), F.col(a).alias("short"), F.col(b).alias("long"))
    return rounded(one(week, "sma_10", "sma_20").unionByName(one(four, "sma_5", "sma_13")))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS price, CASE WHEN p_size % 4 > 0 THEN p_retailprice + p_size END AS high, p_retailprice - p_size AS low, p_size * 2.0 AS rsi, CASE WHEN p_size % 7 > 0 THEN (p_size - 25) / 20.0 END AS hist, p_size + 5.0 AS adx, p_size::DOUBLE AS atr FROM part)
  SELECT p_partkey, printf('%.1f', (coalesce(high, price) - price) / coalesce(high, price) * 100) AS from_high, printf('%.1f', (price - low) / low * 100) AS from_low, CASE WHEN rsi < 25 THEN 'Extremely Oversold - Strong bounce expected' WHEN rsi < 30 THEN 'Oversold - Watch for reversal' WHEN rsi < 40 THEN 'Approaching oversold' WHEN rsi > 80 THEN 'Extremely Overbought - Correction likely' WHEN rsi > 70 THEN 'Overbought - Caution advised' WHEN rsi > 60 THEN 'Approaching overbought' ELSE 'Neutral zone' END AS rsi_reading,
  CASE WHEN hist > 0.5 THEN 'Strong bullish momentum' WHEN hist > 0 THEN 'Bullish momentum building' WHEN hist < -0.5 THEN 'Strong bearish momentum' WHEN hist < 0 THEN 'Bearish momentum building' WHEN hist IS NOT NULL THEN 'Neutral' ELSE 'N/A' END AS macd_reading, printf('%.1f', atr / price * 100) AS atr_text, CASE WHEN atr / price * 100 > 4 THEN 'HIGH volatility - use wider stops' WHEN atr / price * 100 > 2 THEN 'MODERATE volatility' ELSE 'LOW volatility - tighter stops possible' END AS volatility_reading,
  CASE WHEN adx > 50 THEN 'Very strong trend' WHEN adx > 25 THEN 'Strong trend - trade with trend' WHEN adx > 20 THEN 'Developing trend' ELSE 'Weak/No trend - range-bound' END AS adx_reading FROM p""")
def indicator_readings(spark, sf_dir):
    s, price = F.col("p_size"), F.col("p_retailprice")
    p = table(spark, sf_dir, "part").select("p_partkey", price.alias("price"), F.when(s % 4 > 0, price + s).alias("week_52_high"), (price - s).alias("week_52_low"), (s * 2.0).alias("rsi_14"), F.when(s % 7 > 0, (s - 25) / 20.0).alias("macd_hist"), (s + 5.0).alias("adx"), s.cast("double").alias("atr_14"))
    return wording.readings(p).select("p_partkey", "from_high", "from_low", "rsi_reading", "macd_reading", "atr_text", "volatility_reading", "adx_reading")


@query("SELECT s_name AS name, 0 AS priority FROM supplier UNION ALL SELECT c_name, 1 FROM customer")
def sources_united(spark, sf_dir):
    return files.union_all(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query(f"WITH {BARS} SELECT symbol, bar_ts FROM bars QUALIFY bar_ts >= max(bar_ts) OVER (PARTITION BY symbol) - 90")
def bars_since(spark, sf_dir):
    return src.since(src.daily_bars(spark, sf_dir), 90).select("symbol", "bar_ts")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN TIMESTAMP '2024-05-10 12:00:00' - to_hours(event_id % 50) WHEN 2 THEN TIMESTAMP '2024-05-10 12:00:00' - to_days((event_id % 50)::INT) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN TIMESTAMP '2024-05-10 12:00:00' - to_minutes(event_id % 50) ELSE TIMESTAMP '2024-05-10 12:00:00' END AS at FROM events""")
def dates_parsed(spark, sf_dir):
    k, n = F.col("event_id") % 6, (F.col("event_id") % 50).cast("string")
    said = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(n, F.lit(" hours ago"))).when(k == 2, F.concat(F.lit("about "), n, F.lit(" Day ago"))).when(k == 3, F.date_format("ts", "MMM d, yyyy")).when(k == 4, F.concat(n, F.lit(" minutes ago"))).otherwise("soon"))
    at = text.parsed_date(said, F.lit("2024-05-10 12:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props::JSON ->> 'k')::INT END AS k FROM events")
def answers_parsed(spark, sf_dir):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(i == 2, F.concat(F.lit("I think "), "props", F.lit(" fits."))).otherwise("no answer")
    return table(spark, sf_dir, "events").select("event_id", scoring.parsed_analysis(raw, "k int")["k"].alias("k"))


@query("""SELECT doc_id::VARCHAR AS title, 'u' || doc_id AS url, TIMESTAMP '2024-03-01' + to_seconds(doc_id) AS published, source, substr('s' || coalesce(text, ''), 1, 500) AS summary, t AS ticker, r AS relevance FROM (SELECT *, unnest(CASE WHEN doc_id % 3 = 0 THEN [NULL] WHEN doc_id % 3 = 1 THEN ['AB'] ELSE ['AB', 'CD'] END) AS t, unnest(CASE WHEN doc_id % 3 = 0 THEN [NULL] WHEN doc_id % 3 = 1 THEN [0.25::DOUBLE] ELSE [0.25::DOUBLE, NULL] END) AS r FROM documents)""")
def news_from_json(spark, sf_dir):
    """Articles written as JSON lines and read again with the feed's schema, tickers flattened."""
    k = F.col("doc_id")
    one = lambda t, r: F.struct(F.lit(t).alias("ticker"), F.lit(r).alias("relevance_score"), F.lit("0.5").alias("ticker_sentiment_score"), F.lit("Bullish").alias("ticker_sentiment_label"))
    tickers = F.when(k % 3 == 1, F.array(one("AB", "0.25"))).when(k % 3 == 2, F.array(one("AB", "0.25"), one("CD", "none")))
    stamp = F.date_format(F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k.cast("decimal(18,6)")), "yyyyMMdd'T'HHmmss")
    path = scratch(spark, "feed")
    rows = table(spark, sf_dir, "documents").select(k.cast("string").alias("title"), F.concat(F.lit("u"), k).alias("url"), stamp.alias("time_published"), "source", F.concat(F.lit("s"), F.coalesce("text", F.lit(""))).alias("summary"), tickers.alias("ticker_sentiment"))
    files.write(rows, f"{path}/json", "json")
    return files.news_feed(spark, f"{path}/json").select("title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "source", "summary", "ticker", "relevance")


# ------------------------------------------------------------------ sentiment in SQL

_POS, _NEG = "CASE w WHEN 'the' THEN 1.0 WHEN 'with' THEN 0.5 WHEN 'la' THEN 0.7 END", "CASE w WHEN 'of' THEN 0.8 WHEN 'and' THEN 0.6 WHEN 'de' THEN 0.5 END"
_MOD = "CASE {} WHEN 'this' THEN 1.5 WHEN 'are' THEN 0.5 ELSE 1.0 END"
_SENTIMENT = rf"""{_ARTICLES}, parts AS (SELECT article_id, source, 't' AS part, lower(coalesce(title, '')) AS x FROM art UNION ALL SELECT article_id, source, 'd', lower(coalesce(description, '')) FROM art),
toks AS (SELECT article_id, part, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT article_id, part, regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}''‌‍]+') AS ws FROM parts)),
near AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, lag(w, 3) OVER o AS p3, lead(w) OVER o AS nx FROM toks WINDOW o AS (PARTITION BY article_id, part ORDER BY i)),
b AS (SELECT *, CASE WHEN w = 'of' AND nx = 'the' THEN -1.5 WHEN w = 'the' AND nx = 'of' THEN 1.2 END AS bi, (coalesce(p1 IN ('that', 'ne', 'not'), false) OR coalesce(p2 IN ('that', 'ne', 'not'), false) OR coalesce(p3 IN ('that', 'ne', 'not'), false)) AS negated FROM near),
u AS (SELECT *, bi IS NOT NULL OR coalesce(lag(bi) OVER o IS NOT NULL, false) AS used FROM b WINDOW o AS (PARTITION BY article_id, part ORDER BY i)),
u2 AS (SELECT *, coalesce(lag(used) OVER (PARTITION BY article_id, part ORDER BY i), true) AS used_before FROM u),
vals AS (SELECT article_id, part, i, NULL AS w, bi * {_MOD.format('p1')} * CASE WHEN negated THEN -1 ELSE 1 END AS v FROM u2 WHERE bi IS NOT NULL
  UNION ALL SELECT article_id, part, i, w, coalesce({_POS}, -({_NEG}), 0.0) * CASE WHEN used_before THEN 1.0 ELSE {_MOD.format('p1')} END * CASE WHEN negated THEN -1 ELSE 1 END FROM u2 WHERE NOT used AND (({_POS}) IS NOT NULL OR ({_NEG}) IS NOT NULL OR w = 'is')),
sums AS (SELECT article_id, part, coalesce(sum(v) FILTER (v > 0), 0)::DOUBLE AS p, coalesce(-sum(v) FILTER (v < 0), 0)::DOUBLE AS q, count(*) AS k, coalesce(list(w ORDER BY i) FILTER (w IS NOT NULL AND v > 0), [])[1:10] AS up, coalesce(list(w ORDER BY i) FILTER (w IS NOT NULL AND v < 0), [])[1:10] AS down FROM vals GROUP BY 1, 2),
each AS (SELECT x.article_id, x.source, x.part, round(coalesce((p - q) / nullif(p + q, 0), 0), 3) AS s, round(least(ln(1 + coalesce(k, 0)) / ln(21), 1), 3) AS c, coalesce(up, []) AS up, coalesce(down, []) AS down FROM parts x LEFT JOIN sums USING (article_id, part)),
scored AS (SELECT t.article_id, t.source, round((2 * t.s + d.s) / 3, 3) AS score, round((t.c + d.c) / 2, 3) AS confidence, list_sort(list_distinct(t.up || d.up))[1:5] AS up, list_sort(list_distinct(t.down || d.down))[1:5] AS down FROM (SELECT * FROM each WHERE part = 't') t JOIN (SELECT * FROM each WHERE part = 'd') d USING (article_id)),
labelled AS (SELECT *, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM scored)"""


@query(f"WITH {_SENTIMENT} SELECT article_id, score, confidence, label, array_to_string(up, ' ') AS positive, array_to_string(down, ' ') AS negative FROM labelled")
def news_sentiment(spark, sf_dir):
    return text.articles_scored(articles(spark, sf_dir), LEXICON).select("article_id", "score", "confidence", "label", F.array_join("positive_words", " ").alias("positive"), F.array_join("negative_words", " ").alias("negative"))


def _shares(by: str, threshold: float) -> str:
    n = "count(*)"
    counts = ", ".join(f"{n} FILTER (label = '{x}') AS n_{x}, round({n} FILTER (label = '{x}') * 100.0 / {n}, 4) AS {x}_percent" for x in ("positive", "negative", "neutral"))
    mean = "avg(score)"
    return f"{by}round({mean}, 4) AS mean_score, {n} AS n, {counts}, CASE WHEN {mean} > {threshold} THEN 'positive' WHEN {mean} < -{threshold} THEN 'negative' ELSE 'neutral' END AS overall"


@query(f"WITH {_SENTIMENT} SELECT {_shares('source, ', 0.2)} FROM labelled GROUP BY source")
def news_sentiment_by_source(spark, sf_dir):
    return rounded(text.aggregate(text.articles_scored(articles(spark, sf_dir), LEXICON), "source"))


@query(f"WITH {_SENTIMENT} SELECT {_shares('', 0.15)} FROM labelled")
def feed_sentiment(spark, sf_dir):
    return rounded(text.aggregate(text.articles_scored(articles(spark, sf_dir), LEXICON), threshold=0.15))


@query(f"WITH {_SENTIMENT}, g AS (SELECT source, avg(score) AS m, count(*) AS n FROM labelled GROUP BY 1), h AS (SELECT *, CASE WHEN m > 0.2 THEN 'positive' WHEN m < -0.2 THEN 'negative' ELSE 'neutral' END AS o FROM g) SELECT source, o AS overall_sentiment, round(m, 4) AS score, 0.6::DOUBLE AS confidence, 'Analysis of ' || n || ' articles' AS summary, o AS market_impact, 'HOLD' AS recommended_action FROM h")
def sentiment_fallback(spark, sf_dir):
    rows = wording.fallback_sentiment(text.aggregate(text.articles_scored(articles(spark, sf_dir), LEXICON), "source"))
    return rounded(rows, "source", "overall_sentiment", "score", "confidence", "summary", "market_impact", "recommended_action")
