"""Many names in many texts, many searches at once, greedy selections in rounds, and what requests for a company give, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backtest, market, names, text
from .plans import analysis
from .queries import _ARTICLES, _TRADES, _UNIVERSE, _universe, articles, query, rounded, table
from .sources import bars as src

#: Two listings of one company, one without a company's name, an empty symbol and one that is empty without its exchange.
_LISTED = [("RL.NS", "of the"), ("RL.BO", "of the"), ("QU.NS", None), ("LA", "no such name"), ("", None), (".NS", None), ("ZZQ", "")]
_NAMED = "contains(lower(coalesce(title, '')) || chr(10) || lower(coalesce(description, '')), n)"


@query(f"""WITH {_ARTICLES}, v(symbol, broad, n) AS (VALUES ('RL.NS', 0, 'of the'), ('RL.NS', 1, 'rl'), ('RL.BO', 0, 'of the'), ('RL.BO', 1, 'rl'), ('QU.NS', 0, 'qu'), ('LA', 0, 'no such name'), ('LA', 1, 'la'), ('ZZQ', 1, 'zzq')),
  h AS (SELECT symbol, article_id, published, min(broad) AS broad FROM art, v WHERE {_NAMED} GROUP BY 1, 2, 3), k AS (SELECT * FROM h QUALIFY broad = min(broad) OVER (PARTITION BY symbol))
SELECT symbol, article_id, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, article_id)::INT AS rank FROM k QUALIFY rank <= 10""")
def stock_news_of_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.stock_news(articles(spark, sf_dir), spark.createDataFrame(_LISTED, "symbol string, alias string")).select("symbol", "article_id", "rank")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of documents, and customers, whom none names."""
    words = table(spark, sf_dir, "documents").select(F.lower(F.regexp_extract("text", r"^[A-Za-z]+", 0)).alias("name"))
    return words.unionByName(table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))).filter("name <> ''").distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


_FOUND = """WITH n AS (SELECT lower(regexp_extract(text, '^[A-Za-z]+')) AS name FROM documents UNION SELECT lower(c_name) FROM customer)
SELECT name, count(*) AS texts, min(doc_id) AS first_doc, sum(doc_id)::BIGINT AS doc_sum FROM n JOIN documents ON contains(lower(text), name) WHERE name <> '' GROUP BY 1"""


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("doc_sum"))


@query(_FOUND)
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(names.contained(_texts(spark, sf_dir), "doc_id", "text", _names(spark, sf_dir)))


@query(_FOUND)
def names_in_documents_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if the names were too many for an automaton."""
    return _summed(names.contained(_texts(spark, sf_dir), "doc_id", "text", _names(spark, sf_dir), most=0))


_ASKED = [" 12 ", "customer#00000001", "Customer#000000017", "NICA", "0", "no such", "", None, "#"]


@query(f"""WITH {_UNIVERSE}, a AS (SELECT query, upper(trim(query)) AS q FROM (SELECT unnest([' 12 ', 'customer#00000001', 'Customer#000000017', 'NICA', '0', 'no such', '', NULL, '#']) AS query) WHERE trim(query) <> ''),
f AS (SELECT query, symbol, market_cap, CASE WHEN upper(symbol) = q THEN 1 WHEN starts_with(upper(symbol), q) THEN 2 WHEN contains(upper(symbol), q) OR contains(upper(name), q) THEN 3 END AS tier FROM a, u)
SELECT query, symbol, tier, row_number() OVER (PARTITION BY query ORDER BY tier, market_cap DESC, symbol)::INT AS rank FROM f WHERE tier IS NOT NULL QUALIFY rank <= 20""")
def symbol_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.search_many(_universe(spark, sf_dir), spark.createDataFrame([(q,) for q in _ASKED], "query string"))


@query(f"""WITH RECURSIVE {_ARTICLES}, w AS (SELECT article_id, source, 'u' || (article_id % 97) AS url, list_distinct(list_filter(regexp_split_to_array(lower(trim(title)), '\\s+'), lambda x: x <> '')) AS words FROM art),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY article_id) AS i FROM w),
s AS (SELECT source, i, [{{'url': url, 'words': words, 'id': article_id}}] AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.i, CASE WHEN len(list_filter(s.kept, lambda k: k.url = r.url OR (len(k.words) + len(r.words) > 0 AND len(list_intersect(k.words, r.words)) >= 0.8 * len(list_distinct(k.words || r.words))))) > 0 THEN s.kept ELSE list_append(s.kept, {{'url': r.url, 'words': r.words, 'id': r.article_id}}) END
  FROM s JOIN r ON r.source = s.source AND r.i = s.i + 1)
SELECT source, k.id AS article_id FROM (SELECT source, unnest(kept) AS k FROM s QUALIFY i = max(i) OVER (PARTITION BY source))""")
def news_first_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keep_first_in_rounds(articles(spark, sf_dir), "source")


_NOW = "2024-03-01 00:00:00"


@query("""WITH r AS (SELECT 'q' || (doc_id % 5) AS query, CASE WHEN doc_id % 3 = 0 THEN 'ddg' ELSE 'serp' END AS provider, doc_id AS position, CASE WHEN doc_id % 7 < 3 THEN TIMESTAMP '2024-03-01' - to_hours(doc_id % 300) WHEN doc_id % 7 < 5 THEN TIMESTAMP '2024-03-01' - to_days((doc_id % 12)::INT) WHEN doc_id % 7 = 5 THEN NULL ELSE date_trunc('day', TIMESTAMP '2024-03-01' - to_days((doc_id % 11)::INT)) END AS published FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY query, provider ORDER BY position) AS rank FROM r)
SELECT query, provider, position, rank::INT AS rank, published FROM k WHERE provider = CASE WHEN query IN ('q1', 'q3') THEN 'ddg' WHEN query = 'q4' THEN 'none' ELSE 'serp' END AND rank <= 10 AND (published IS NULL OR published >= TIMESTAMP '2024-03-01' - INTERVAL 7 DAYS)""")
def web_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five queries two fail at the first provider, one at both."""
    k = F.col("doc_id")
    now = F.lit(_NOW).cast("timestamp")
    days = F.make_dt_interval((k % 11).cast("int"))
    date = F.when(k % 7 < 3, F.concat(k % 300, F.lit(" hours ago"))).when(k % 7 < 5, F.concat(k % 12, F.lit(" Days ago"))).when(k % 7 == 5, "some day").otherwise(F.date_format(now - days, "MMM d, yyyy"))
    results = table(spark, sf_dir, "documents").select(F.concat(F.lit("q"), k % 5).alias("query"), F.when(k % 3 == 0, "ddg").otherwise("serp").alias("provider"), k.alias("position"), date.alias("date"))
    failed = {("q1", "serp"), ("q3", "serp"), ("q4", "serp"), ("q4", "ddg")}
    attempts = spark.createDataFrame([(q, p, n, (q, p) not in failed) for q in ("q0", "q1", "q2", "q3", "q4") for n, p in enumerate(("serp", "ddg"))], "query string, provider string, priority int, answered boolean")
    out = text.web_results(results, attempts, now)
    return out.select("query", "provider", "position", "rank", F.col("published").cast("timestamp_ntz").alias("published"))


@query(f"""WITH {_UNIVERSE} SELECT symbol, market_cap, pe_ratio, roe, debt AS debt_to_equity, forward_pe, 'screener' AS source FROM (SELECT *, NULL::DOUBLE AS forward_pe FROM u) WHERE symbol IN (SELECT c_name FROM customer WHERE c_custkey % 10 = 3)""")
def company_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3").select(F.col("c_name").alias("symbol")).unionByName(spark.createDataFrame([("nobody",)], "symbol string"))
    found = market.fundamentals(_universe(spark, sf_dir).withColumn("source", F.lit("screener")), asked)
    return found.select("symbol", "market_cap", "pe_ratio", "roe", "debt_to_equity", "forward_pe", "source")


@query(f"""{_TRADES}, names AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol FROM lineitem UNION SELECT n_name FROM nation)
SELECT n.symbol, count(t.symbol) AS trades, count(*) FILTER (return_percent > 0) AS wins, round(coalesce(avg(return_percent), 0), 4) AS mean_return, round(coalesce(avg(hold_days), 0), 4) AS mean_hold, count(*) FILTER (exit_reason = 'target') AS n_target FROM names n LEFT JOIN trades t ON t.symbol = n.symbol GROUP BY 1""")
def backtest_of_all_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations have no bars, and so no trades."""
    bars = src.daily_bars(spark, sf_dir)
    symbols = bars.select("symbol").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")))
    return rounded(backtest.statistics_of(symbols, analysis.backtested(bars)[0]), "symbol", "trades", "wins", "mean_return", "mean_hold", "n_target")
