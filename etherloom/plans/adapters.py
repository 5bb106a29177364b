"""The driver's tables in the shape of captures, and the same shapes as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etherloom.operators import matrix, observe

FIELDS = ["EVENT", "PROPS", "BUCKET"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_requests(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Events as probe requests: a user's address changes by day; equal content is one request with many frames.

    They are counted where the column ``by`` brings them, all of a value together, if it is given.
    """
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("mac"),
        F.col("user_id").cast("string").alias("device"), F.col("event_type").alias("EVENT"), F.col("props").alias("PROPS"),
        F.floor(F.col("value") / 10).cast("string").alias("BUCKET"),
    )
    return (rows.repartition(by) if by else rows).groupBy(*rows.columns).agg(F.count("*").alias("n_frames"))


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_requests(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(observe.NULL)).alias("value")) for f in FIELDS])
    return requests.select("mac", "device", "n_frames", F.inline(each))


def event_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.joint_counts(event_observations(spark, sf_dir))


SQL = """
WITH pr AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS mac, CAST(user_id AS VARCHAR) AS device,
         event_type, props, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS bucket, count(*) AS n_frames
  FROM events GROUP BY ALL
), obs AS (
  SELECT mac, device, 'EVENT' AS field, coalesce(event_type, 'NULL') AS value, n_frames FROM pr
  UNION ALL SELECT mac, device, 'PROPS', coalesce(props, 'NULL'), n_frames FROM pr
  UNION ALL SELECT mac, device, 'BUCKET', coalesce(bucket, 'NULL'), n_frames FROM pr
), joint AS (SELECT field, device, value, CAST(sum(n_frames) AS BIGINT) AS n FROM obs GROUP BY ALL),
kv AS (SELECT field, value, count(DISTINCT device) AS k FROM obs GROUP BY ALL),
fp AS (SELECT mac, device, coalesce(event_type, 'NULL') || '|' || coalesce(bucket, 'NULL') AS f FROM pr)
"""


def customer_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as addresses: the market segment is the cluster (HOUSEHOLD is noise), the nation the label."""
    c = table(spark, sf_dir, "customer")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
    cluster = F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment")).cast("int") - 1
    mac = F.col("c_custkey").alias("mac")
    return c.select(mac, cluster.alias("cluster")), c.select(mac, F.col("c_nationkey").alias("label"))


#: three clusterings of the customers: by market segment, by balance, and by order with much noise
SCENARIO_RULES = {
    "segment": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE -1 END",
    "balance": "CAST(floor(c_acctbal / 1500) AS INTEGER)",
    "order": "CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE CAST(c_custkey % 17 AS INTEGER) END",
}


def scenario_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario, mac, cluster`` of the three clusterings."""
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), F.expr(rule).cast("int").alias("cluster")) for n, rule in SCENARIO_RULES.items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mac"), F.inline(each))


CK_SQL = """
WITH m AS (
  SELECT c_custkey AS mac, c_nationkey AS label, CAST({rule} AS INTEGER) AS cluster FROM customer
), e AS (SELECT * FROM m WHERE label IS NOT NULL {noise}),
ck AS (SELECT cluster, label, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT cluster, sum(n) AS nk, max(n) AS mk, count(*) AS lk FROM ck GROUP BY ALL),
c AS (SELECT label, sum(n) AS nc, max(n) AS mc, count(*) AS kc FROM ck GROUP BY ALL),
t AS (SELECT sum(n) AS total FROM ck)
"""


CAPTURE_FIELDS = ["EVENT", "TAGS", "RTS.SUPP", "DATA.RTS.EXT", "FLAG", "VENDOR", "TXT", "RSSI", ""]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested captures: ``MAC, LABEL, PROBE_REQs, file, cap``.

    A user's address holds for ten days and is captured each day, so equal addresses stand in several rows; the label
    is missing on every third day and changes on others. Requests of errors have no frames. DATA has a list with a
    null, objects, booleans, and a plain string that begins like a list.
    """
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    letter = F.char((65 + F.col("user_id") % 26).cast("int"))
    label = F.when(day % 3 == 1, F.concat(F.lit("data_dev"), letter, F.lit("_dataset"))).when(day % 3 == 2, F.concat(F.lit("x_dev"), F.lower(letter)))
    b = F.get_json_object("props", "$.k").cast("int") % 4
    frame = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), F.floor("value").cast("long").alias("v"))
    one = e.select(
        F.concat_ws("-", F.concat(F.lit("M"), "user_id"), F.floor((day - 1) / 10).cast("string")).alias("MAC"), label.alias("LABEL"),
        F.date_format("ts", "yyyyMMdd").cast("long").alias("cap"), F.col("event_type").alias("kind"), b.alias("b"), frame.alias("frame"),
    )
    one = one.groupBy("MAC", "LABEL", "cap", "kind", "b").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    none = F.array().cast("array<struct<t:string,v:bigint>>")
    frames = F.when(F.col("kind") == "error", none).otherwise(F.col("frames"))
    text = F.to_json(
        F.struct(
            F.when(F.col("kind") != "view", F.col("kind")).alias("EVENT"),
            F.struct(F.when(F.col("b") % 2 == 1, F.array(F.col("b").cast("string"))).alias("EXT"), F.array(F.col("b").cast("string")).alias("SUPP")).alias("RTS"),
            F.struct(F.lit("1").alias("z"), F.col("b").cast("string").alias("a")).alias("VENDOR"), F.concat(F.lit("["), F.col("b").cast("string")).alias("TXT"),
        )
    )
    extra = F.concat(F.lit(',"TAGS":['), "b", F.lit(","), F.col("b") + 1, F.lit(',null],"FLAG":'), F.when(F.col("b") < 2, (F.col("b") == 1).cast("string")).otherwise("null"), F.lit("}"))
    data = F.concat(F.expr("left(text, length(text) - 1)"), F.col("extra"))
    request = F.struct("kind", "b", F.transform("frames", lambda x: x["t"]).alias("TIME"), F.transform("frames", lambda x: (-x["v"]).cast("string")).alias("RSSI"), data.alias("DATA"))
    one = one.withColumns({"frames": frames, "text": text, "extra": extra}).groupBy("MAC", "LABEL", "cap").agg(F.array_sort(F.collect_list(request)).alias("requests"))
    made = F.transform("requests", lambda r: F.struct(r["TIME"].alias("TIME"), r["RSSI"].alias("RSSI"), F.parse_json(r["DATA"]).alias("DATA")))
    file = F.concat(F.lit("/in/"), F.coalesce("LABEL", F.lit("other")), F.lit("/"), F.col("cap").cast("string"), F.lit(".json"))
    return one.select("MAC", "LABEL", made.alias("PROBE_REQs"), file.alias("file"), "cap")


def capture_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.probe_requests(captures(spark, sf_dir), "cap")


def capture_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.observations(capture_requests(spark, sf_dir), CAPTURE_FIELDS)


def capture_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.joint_counts(capture_observations(spark, sf_dir))


CAPTURE_SQL = """
WITH ev AS (
  SELECT 'M' || user_id || '-' || (day(ts) - 1) // 10 AS mac, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS cap, event_type AS kind,
    CASE day(ts) % 3 WHEN 1 THEN 'data_dev' || chr(CAST(65 + user_id % 26 AS INTEGER)) || '_dataset' WHEN 2 THEN 'x_dev' || chr(CAST(97 + user_id % 26 AS INTEGER)) END AS label,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS b, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, -CAST(floor(value) AS BIGINT) AS v
  FROM events
), req AS (
  SELECT mac, label, coalesce(label, mac) AS device, cap, kind, b, row_number() OVER (PARTITION BY mac, cap ORDER BY kind, b) - 1 AS pr_ord,
    CASE WHEN kind = 'error' THEN 0 ELSE count(*) END AS n_frames,
    CASE WHEN kind = 'error' THEN [] ELSE list(t ORDER BY t, -v) END AS times,
    CASE WHEN kind = 'error' THEN '[]' ELSE '[' || string_agg(CAST(v AS VARCHAR), ',' ORDER BY t, -v) || ']' END AS rssi
  FROM ev GROUP BY mac, label, cap, kind, b
), obs AS (
  SELECT mac, device, cap, pr_ord, n_frames, field, CASE field WHEN 'EVENT' THEN CASE WHEN kind = 'view' THEN 'NULL' ELSE kind END
    WHEN 'TAGS' THEN '[' || b || ',' || (b + 1) || ',None]' WHEN 'RTS.SUPP' THEN '[' || b || ']'
    WHEN 'DATA.RTS.EXT' THEN CASE WHEN b % 2 = 1 THEN '[' || b || ']' ELSE 'NULL' END
    WHEN 'FLAG' THEN CASE b WHEN 0 THEN 'False' WHEN 1 THEN 'True' ELSE 'NULL' END
    WHEN 'VENDOR' THEN '{a:' || b || ',z:1}' WHEN 'TXT' THEN '[' || b WHEN 'RSSI' THEN rssi ELSE 'NULL' END AS value
  FROM req, (SELECT unnest(['EVENT', 'TAGS', 'RTS.SUPP', 'DATA.RTS.EXT', 'FLAG', 'VENDOR', 'TXT', 'RSSI', '']) AS field)
), joint AS (SELECT field, device, value, CAST(sum(n_frames) AS BIGINT) AS n FROM obs GROUP BY ALL),
kv AS (SELECT field, value, count(DISTINCT device) AS k FROM obs GROUP BY ALL)
"""


MATRIX_KINDS = {"HEX": "hex_bit", "RATES": "data_rates"}


def nation_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as addresses, customers as their requests: a balance as hexadecimal field, and those of builders as a set."""
    c = table(spark, sf_dir, "customer")
    hexed = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.floor(F.abs("c_acctbal") / 100).cast("long"))), 4, "0"))
    rate = F.when(F.col("c_mktsegment") == "BUILDING", F.floor(F.col("c_acctbal") / 1000).cast("string"))
    each = F.array(
        F.struct(F.lit("HEX").alias("field"), F.coalesce(hexed, F.lit(observe.NULL)).alias("value")),
        F.struct(F.lit("RATES").alias("field"), F.coalesce(rate, F.lit(observe.NULL)).alias("value")),
    )
    return c.select(F.col("c_nationkey").cast("long").alias("mac"), F.col("c_custkey").alias("pr_ord"), F.inline(each))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('both', map('HEX', 1.0D)), ('bits', map('HEX', 1.0D, 'RATES', 0.0D)), ('mixed', map('HEX', 2.0D, 'RATES', 0.5D)) AS (scenario, weights)"
    )


UNIT_SQL = """
WITH h AS (SELECT c_nationkey::BIGINT AS mac, CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS v, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT c_nationkey::BIGINT AS mac, list(DISTINCT floor(c_acctbal / 1000)) FILTER (c_mktsegment = 'BUILDING') AS s FROM customer GROUP BY ALL),
u AS (
  SELECT 'HEX' AS field, a.mac AS i, b.mac AS j, sum(a.n * b.n * bit_count(xor(a.v, b.v)) / 16.0::DOUBLE) / sum(a.n * b.n) AS unit
  FROM h a JOIN h b ON a.mac <= b.mac GROUP BY a.mac, b.mac
  UNION ALL
  SELECT 'RATES', a.mac, b.mac, CASE WHEN a.s IS NULL AND b.s IS NULL THEN 0.0 WHEN a.s IS NULL OR b.s IS NULL THEN 1.0
    ELSE len(a.s) + len(b.s) - 2 * len(list_intersect(a.s, b.s)) END::DOUBLE FROM r a JOIN r b ON a.mac <= b.mac
), w AS (SELECT * FROM (VALUES ('both', 'HEX', 1.0::DOUBLE), ('both', 'RATES', 1.0), ('bits', 'HEX', 1.0), ('bits', 'RATES', 0.0), ('mixed', 'HEX', 2.0), ('mixed', 'RATES', 0.5)) AS t (scenario, field, w)),
d AS (SELECT scenario, i, j, greatest(sum(w * unit), 0) AS distance FROM u JOIN w USING (field) GROUP BY ALL)
"""


SUPPLIER_SPECS = {
    "HEX": matrix.Spec("hex_bit", (2.0,), 0.5),
    "TAGS": matrix.Spec("ie_list", (0.5,)),
    "EXT": matrix.Spec("ext_tag", (0.5, 1.0, 0.25)),
    "VENDOR": matrix.Spec("vendor_spec", (1.0, 2.0, 0.5)),
    "FRAMES": matrix.Spec("rssi_time", (1.1, 0.5, 0.2, 3.0)),
}


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as addresses with a field of each kind; fields are missing, payloads are odd, lists have an order."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mac"), F.floor(F.abs("s_acctbal")).cast("long").alias("a"))
    hexed = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c % 16**n)), n, "0"))
    m, a = F.col("mac"), F.col("a")
    letter = lambda c: F.char((97 + c).cast("int"))
    ext = F.to_json(F.struct(F.when(m % 2 == 0, hexed(a, 2)).alias("1"), F.when(m % 3 != 0, F.when(m % 4 < 2, hexed(a, 2)).otherwise(hexed(a, 4))).alias("2")))
    other = F.struct(F.when(m % 2 == 0, hexed(a + 1, 2)).alias("y"), F.when(m % 2 == 1, hexed(a + 1, 2)).alias("z"))
    vendor = F.to_json(F.struct(F.struct(hexed(a, 2).alias("x")).alias("u"), F.when(m % 3 == 0, other).alias("w")))
    rows = [
        ("HEX", 0, F.when(m % 5 != 0, F.when(m % 7 == 1, "0x").otherwise(hexed(a, 4)))),
        ("TAGS", 0, letter(m % 3)), ("TAGS", 1, letter(a % 2)), ("TAGS", 2, F.when(m % 4 != 0, letter(m % 2))),
        ("EXT", 0, F.when(m % 10 != 9, ext)), ("VENDOR", 0, vendor),
    ]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("pr_ord"), F.coalesce(v, F.lit(observe.NULL)).alias("value")) for f, k, v in rows])
    level = lambda c: (-40 - c).cast("string")
    frames = s.select("mac", F.array(level(m % 5), level(a % 7)).alias("rssi"), F.array((m % 10).cast("string"), (a % 10).cast("string")).alias("time"))
    return matrix.profiles(s.select("mac", F.inline(each)), ordered=["TAGS"]).unionByName(matrix.frame_profiles(frames, "FRAMES"))


CUSTOMER_SPECS = {"HEX": matrix.Spec("hex_bit", (2.0,), 0.75), "RATES": matrix.Spec("data_rates", (0.5,))}


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as addresses: a balance as hexadecimal digits and a set of two values; some lack one of them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mac"), F.floor(F.abs("c_acctbal")).cast("long").alias("a"), F.col("c_nationkey").alias("n"))
    m, one = F.col("mac"), lambda v: F.struct(v.alias("v"), F.lit(1).cast("long").alias("n"))
    hexed = F.array(one(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("a") % 65536)), 4, "0"))))
    rates = F.array_sort(F.array(one((F.col("n") % 7).cast("string")), one((7 + m % 5).cast("string"))))
    none = F.array().cast("array<struct<v:string,n:bigint>>")
    fields = [("HEX", F.when(m % 11 != 0, hexed).otherwise(none)), ("RATES", F.when(m % 13 != 0, rates).otherwise(none))]
    return c.select("mac", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("values")) for f, v in fields])))


#: suppliers' fields under names that the registry knows
REGISTRY_NAMES = {"HEX": "HT_CAP", "TAGS": "TAG_LIST"}


def registry_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = supplier_profiles(spark, sf_dir).where(F.col("field").isin(list(REGISTRY_NAMES)))
    return prof.replace(REGISTRY_NAMES, subset=["field"])


SUPPLIER_SQL = """
WITH s AS (SELECT s_suppkey AS mac, CAST(floor(abs(s_acctbal)) AS BIGINT) AS a FROM supplier),
v AS (
  SELECT mac, CASE WHEN mac % 5 <> 0 THEN a % 65536 END AS hex, mac % 7 = 1 AS bad,
    chr(CAST(97 + mac % 3 AS INTEGER)) || chr(CAST(97 + a % 2 AS INTEGER)) || CASE WHEN mac % 4 <> 0 THEN chr(CAST(97 + mac % 2 AS INTEGER)) ELSE '' END AS tags,
    mac % 10 <> 9 AS has, CASE WHEN mac % 2 = 0 THEN a % 256 END AS e1, CASE WHEN mac % 3 <> 0 THEN CASE WHEN mac % 4 < 2 THEN a % 256 ELSE a % 65536 END END AS e2,
    CASE WHEN mac % 4 < 2 THEN 8 ELSE 16 END AS l2, a % 256 AS x, mac % 3 = 0 AS w, mac % 2 AS wt, (a + 1) % 256 AS wv,
    [mac % 5, a % 7] AS r, [mac % 10, a % 10] AS t FROM s
), p AS (
  SELECT l.mac AS i, r.mac AS j,
    CASE WHEN l.hex IS NULL AND r.hex IS NULL THEN 0.0 WHEN l.hex IS NULL OR r.hex IS NULL OR l.bad OR r.bad THEN 0.5 ELSE bit_count(xor(l.hex, r.hex)) / 16.0::DOUBLE END AS hex,
    list_sum(list_transform(['a', 'b', 'c'], lambda c: abs(len(replace(l.tags, c, '')) - len(l.tags) - len(replace(r.tags, c, '')) + len(r.tags)))) + greatest(len(l.tags), len(r.tags))
      - list_max(list_transform(range(8), lambda k: CASE WHEN r.tags LIKE '%' || CASE WHEN k & 1 > 0 THEN l.tags[1] || '%' ELSE '' END || CASE WHEN k & 2 > 0 THEN l.tags[2] || '%' ELSE '' END
        || CASE WHEN k & 4 > 0 AND len(l.tags) > 2 THEN l.tags[3] || '%' ELSE '' END THEN bit_count(CASE WHEN len(l.tags) > 2 THEN k ELSE k & 3 END) ELSE 0 END)) AS tags,
    CASE WHEN NOT l.has AND NOT r.has THEN 0.0 WHEN NOT l.has OR NOT r.has THEN (0.5 + 1.0 + 0.25) / 3 ELSE
      coalesce(bit_count(xor(l.e1, r.e1)) / 8.0::DOUBLE, 0) + coalesce(bit_count(xor(l.e2, r.e2)) / l.l2::DOUBLE, 0)
      + 0.5 * (((l.e1 IS NULL) <> (r.e1 IS NULL))::INT + ((l.e2 IS NULL) <> (r.e2 IS NULL))::INT)
      - 0.25 * ((l.e1 IS NOT NULL AND r.e1 IS NOT NULL)::INT + (l.e2 IS NOT NULL AND r.e2 IS NOT NULL)::INT) END AS ext,
    2.0 * bit_count(xor(l.x, r.x)) / 8.0::DOUBLE + 0.5 + CASE WHEN l.w AND r.w AND l.wt = r.wt THEN 2.0 * bit_count(xor(l.wv, r.wv)) / 8.0::DOUBLE + 0.5 ELSE 0 END
      + CASE WHEN l.w AND r.w THEN -2 WHEN l.w OR r.w THEN 0 ELSE -1 END AS vendor,
    list_min(list_transform(range(4), lambda k: power(1.1::DOUBLE, abs(l.r[(k & 1) + 1] - r.r[(k >> 1) + 1])) + CASE WHEN abs(l.t[(k & 1) + 1] - r.t[(k >> 1) + 1]) > 3 THEN 0.5 ELSE -0.5 END + 0.2)) AS frames
  FROM v l, v r
)
"""
