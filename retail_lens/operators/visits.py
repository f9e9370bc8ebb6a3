"""Visits over time: ledgers, histories, refusal windows, buckets and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..registry import query

AS_OF = "2024-01-31 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``: a maximum, which combines before the shuffle, where a window would not."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in dict.fromkeys([*order, *columns])))


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) SELECT user_id, event_id, event_type FROM r WHERE k = 1")
def latest_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last visit of each store in the ten days before a stated time."""
    recent = events(spark, sf_dir).where(F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 10 DAYS"))
    return latest_per_key(recent, "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 1 AND event_type <> 'error'")
def settled_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores whose last visit need not be made again."""
    return latest_per_key(events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"]).where("event_type <> 'error'").select("user_id", "event_id")


@query("WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS blocked FROM events GROUP BY 1, 2), h AS (SELECT user_id, count(*) AS days, bool_and(blocked) AS every, bool_or(blocked) AS ever, arg_max(blocked, day) AS last FROM s GROUP BY 1) SELECT user_id, days, CASE WHEN every THEN 'always' WHEN last THEN 'sometimes' WHEN ever THEN 'recovered' ELSE 'never' END AS state FROM h")
def block_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a store is always blocked, now and then, no longer, or never."""
    s = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("blocked"))
    h = s.groupBy("user_id").agg(F.count("*").alias("days"), F.bool_and("blocked").alias("every"), F.bool_or("blocked").alias("ever"), F.max_by("blocked", "day").alias("last"))
    return h.select("user_id", "days", F.when(F.col("every"), "always").when(F.col("last"), "sometimes").when(F.col("ever"), "recovered").otherwise("never").alias("state"))


@query("SELECT user_id, max(event_id) AS last_error, round(arg_max(value, (ts, event_id)), 2) AS last_value FROM events WHERE event_type = 'error' GROUP BY user_id")
def last_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last refused visit of each store."""
    return events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("last_error"), F.round(F.max_by("value", F.struct("ts", "event_id")), 2).alias("last_value"))


@query("WITH e AS (SELECT user_id % 10 AS net, user_id AS host, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), w AS (SELECT a.net AS net, a.t AS t, count(DISTINCT b.host) AS hosts FROM e a JOIN e b ON a.net = b.net AND b.t BETWEEN a.t - 36000000000 AND a.t GROUP BY 1, 2) SELECT net, count(*) AS refusals, CAST(count(*) FILTER (WHERE hosts >= 2) AS BIGINT) AS limited FROM w GROUP BY net")
def refusal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals at which at least two hosts of a network had refused within ten hours: a range frame over time.

    Time is cut in slices as long as the frame, and each slice has the rows of the one before it too: a busy network is many tasks'.
    """
    e = events(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 10).alias("net"), F.col("user_id").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    long = 36_000_000_000
    slot = F.floor(F.col("t") / long)
    e = e.withColumn("s", F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))).select("net", "host", "t", "s.slot", "s.own")
    frame = Window.partitionBy("net", "slot").orderBy("t").rangeBetween(-long, 0)
    w = e.withColumn("hosts", F.size(F.collect_set("host").over(frame))).where("own").groupBy("net", "t").agg(F.max("hosts").alias("hosts"))
    return w.groupBy("net").agg(F.count("*").alias("refusals"), F.count_if(F.col("hosts") >= 2).alias("limited"))


# Seconds in which so many hosts of a network must refuse for it to be limiting us, the status that says so by itself, and the cooldown after the first time and at most.
REFUSAL_SECONDS, REFUSAL_HOSTS, TOO_MANY, COOLDOWN, MOST_COOLDOWN = 600, 2, 429, 300, 1800


def limits(refusals: DataFrame, seconds: int = REFUSAL_SECONDS, least: int = REFUSAL_HOSTS) -> DataFrame:
    """(net, event_id, hosts, limited, cool_s) of refusals (net, event_id, ts, host, status): how many hosts of the network refused in the ``seconds`` up to it, whether that or the
    status says that the network limits us, and the cooldown then, which doubles each time. Refusals of one moment count for each other.

    A network's time is cut in slices as long as the window, each with the one before it, and the times that it limited us are counted by slices first: a busy network is many tasks'.
    """
    long = seconds * 1_000_000
    t = refusals.select("net", "event_id", "host", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    slot = F.floor(F.col("t") / long)
    e = t.withColumn("s", F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))).select("net", "event_id", "host", "status", "t", "s.slot", "s.own")
    frame = Window.partitionBy("net", "slot").orderBy("t").rangeBetween(-long, 0)
    w = e.withColumn("hosts", F.size(F.collect_set("host").over(frame))).where("own").withColumn("limited", (F.col("status") == TOO_MANY) | (F.col("hosts") >= least))
    per = w.groupBy("net", "slot").agg(F.count_if("limited").alias("n"))
    per = per.select("net", "slot", (F.sum("n").over(Window.partitionBy("net").orderBy("slot")) - F.col("n")).alias("before"))
    nth = F.col("before") + F.count_if("limited").over(Window.partitionBy("net", "slot").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    cool = F.least(F.lit(COOLDOWN) * F.pow(F.lit(2), F.least(nth - 1, F.lit(20))), F.lit(MOST_COOLDOWN)).cast("long")
    return w.join(per, ["net", "slot"]).select("net", "event_id", F.col("hosts").cast("long").alias("hosts"), "limited", F.when(F.col("limited"), cool).alias("cool_s"))


def refused(df: DataFrame) -> DataFrame:
    """Errors among events as refusals of hosts on ten networks; a note over 95 stands for the status that says too many."""
    status = F.when(F.get_json_object("props", "$.k").cast("int") >= 95, TOO_MANY).otherwise(403)
    return df.where("event_type = 'error'").select((F.col("user_id") % 10).alias("net"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("host"), status.alias("status"))


@query("""WITH e AS (SELECT user_id % 10 AS net, event_id, user_id AS host, epoch_us(ts) AS t, CAST(props->>'$.k' AS INT) >= 95 AS many FROM events WHERE event_type = 'error'),
w AS (SELECT a.net AS net, a.event_id AS event_id, a.t AS t, a.many AS many, count(DISTINCT b.host) AS hosts FROM e a JOIN e b ON a.net = b.net AND b.t BETWEEN a.t - 600000000 AND a.t GROUP BY ALL),
l AS (SELECT *, many OR hosts >= 2 AS limited FROM w), n AS (SELECT *, count(*) FILTER (WHERE limited) OVER (PARTITION BY net ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT net, event_id, hosts, limited, CASE WHEN limited THEN CAST(least(300 * pow(2, least(n - 1, 20)), 1800) AS BIGINT) END AS cool_s FROM n""")
def network_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refusal with the hosts of its network that refused within ten minutes, whether the network limits us, and the cooldown."""
    return limits(refused(events(spark, sf_dir)))


@query("WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') SELECT user_id, CAST(k AS BIGINT) AS attempt, CAST(least(300 * pow(2, least(k - 1, 10)), 1800) AS BIGINT) AS wait_s FROM k")
def cooldown_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doubling wait after each refusal of a store, up to half an hour."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, sf_dir).where("event_type = 'error'").select("user_id", k.cast("long").alias("attempt"))
    return e.withColumn("wait_s", F.least(300 * F.pow(F.lit(2), F.least(F.col("attempt") - 1, F.lit(10))), F.lit(1800)).cast("long"))


_BUCKETS = "count(*) AS sessions, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS cart, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS checkout"


def buckets(df: DataFrame, width: str) -> DataFrame:
    """Sessions, carts and checkouts of each time bucket; the same expression serves batches and streams."""
    b = df.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("sessions"), F.count_if(F.col("event_type") == "click").alias("cart"), F.count_if(F.col("event_type") == "purchase").alias("checkout"))
    return b.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "sessions", "cart", "checkout")


@query(f"SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, {_BUCKETS} FROM events GROUP BY 1")
def minute_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic by the minute."""
    return buckets(events(spark, sf_dir), "1 minute")


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, {_BUCKETS} FROM events GROUP BY 1")
def hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic by the hour."""
    return buckets(events(spark, sf_dir), "1 hour")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS city, count(*) AS sessions FROM events GROUP BY 1 ORDER BY sessions DESC, city LIMIT 25")
def top_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 cities with the most sessions."""
    return events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("long").alias("city")).agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "city").limit(25)


@query("SELECT round(count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (7, 13, 42)) / count(*), 6) AS data_center_share FROM events")
def data_center_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of sessions from cities that hold data centres."""
    return events(spark, sf_dir).agg(F.round(F.count_if(F.get_json_object("props", "$.k").cast("long").isin(7, 13, 42)) / F.count("*"), 6).alias("data_center_share"))


@query("WITH c AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS tokens, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM conversations) SELECT conv_id, turn, tokens, CASE WHEN spent >= 1500 THEN 'skipped_budget' ELSE 'ok' END AS status FROM c")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a run that find its budget spent by the calls before them are skipped."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.char_length("text").cast("long")
    spent = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("tokens"), F.when(spent >= 1500, "skipped_budget").otherwise("ok").alias("status"))


@query("SELECT conv_id, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(CASE WHEN role = 'user' THEN length(text) * 5 ELSE length(text) * 15 END) / 1e6, 6) AS cost_usd FROM conversations GROUP BY conv_id")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost of each run."""
    n = F.char_length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(n).alias("tokens"), F.round(F.sum(F.when(F.col("role") == "user", n * 5).otherwise(n * 15)) / 1e6, 6).alias("cost_usd"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS stores, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and stores by outcome, and each outcome's share."""
    o = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("stores"))
    return o.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row an outcome


@query("WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT user_id, day, n, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS before FROM p) SELECT user_id, CAST(day AS VARCHAR) AS day, n, before FROM l WHERE n IS DISTINCT FROM before")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a store's count of visits differs from its day before."""
    p = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    c = p.withColumn("before", F.lag("n").over(Window.partitionBy("user_id").orderBy("day")))
    return c.where(~F.col("n").eqNullSafe(F.col("before"))).select("user_id", F.col("day").cast("string").alias("day"), "n", "before")


@query("WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents) SELECT count(*) AS numbers, count(DISTINCT doc_id) AS documents, CAST(max(length(x)) AS BIGINT) AS longest FROM p")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers that stand in documents."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("x"))
    return p.agg(F.count("*").alias("numbers"), F.countDistinct("doc_id").alias("documents"), F.max(F.length("x")).cast("long").alias("longest"))
